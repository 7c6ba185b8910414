"""The command line runs a view and a SQL statement over the registered views."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def run(*args):
    env = {**os.environ, "PYTHONPATH": ROOT}
    return subprocess.run([sys.executable, "-m", "tidemark", *args], capture_output=True, text=True,
                          cwd=ROOT, env=env, timeout=300)


def test_list():
    out = run("list")
    assert out.returncode == 0 and len(out.stdout.split()) == 60


def test_show_and_sql():
    out = run("show", "dim_device", "--sf-dir", SF_SMALL)
    assert out.returncode == 0 and "Android" in out.stdout
    out = run("sql", "SELECT count(*) AS n FROM dim_device", "--sf-dir", SF_SMALL)
    assert out.returncode == 0 and "|3  |" in out.stdout


def test_build_then_query_stored_star(scratch):
    out = os.path.join(scratch, "cli-build")
    built = run("build", "--out", out, "--sf-dir", SF_SMALL)
    assert built.returncode == 0 and len(built.stdout.splitlines()) == 57      # all but the plain views
    shown = run("show", "kpi_mrr", "--as-of", "2025-08-01", "--star", out)
    direct = run("show", "kpi_mrr", "--sf-dir", SF_SMALL)
    assert shown.returncode == 0 and shown.stdout == direct.stdout
