"""Serve the results by name to SQL users (the report's views were read by
name by the dashboard).

``register_stored`` serves a finished build: its stored copies under their names,
and the report's plain views as SQL views over the build's star
(plans.plain_views), evaluated at every read. ``register_views`` registers each
result as a session temp view over its plan. Every read re-runs the plan, with
the anchors of the registration; ``live`` resolves them anew at each call, for
any result and any source of tables. Names are the query keys, optionally
prefixed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.params import Params
from tidemark.plans import plain_views
from tidemark.plans.registry import ALL, run
from tidemark.sources import paths as files
from tidemark.sources.star import Tables


def register_views(t: Tables, p: Params | None = None, names=None, prefix: str = "") -> list[str]:
    done = []
    for name in names or list(ALL):
        run(name, t, p or Params()).createOrReplaceTempView(prefix + name)
        done.append(prefix + name)
    return done


def live(load, name: str, p: Params | None = None):
    """The result over ``load()``, a fresh Tables: anchors, calendar and current
    date are those of the call."""
    return run(name, load(), p or Params())


def register_stored(spark: SparkSession, run_dir: str, prefix: str = "", p: Params | None = None) -> list[str]:
    """Names of a build's results: ``run_dir`` is its folder (``materialize.current``)
    or the ``views`` folder in it."""
    run_dir = run_dir.rstrip("/").removesuffix("/views")
    done = []
    for name in ALL:
        path = f"{run_dir}/views/{name}"
        if files.exists(spark, f"{path}/_SUCCESS"):
            spark.read.parquet(path).createOrReplaceTempView(prefix + name)
            done.append(prefix + name)
    if files.exists(spark, f"{run_dir}/star"):
        done += plain_views.create(spark, f"{run_dir}/star", p, prefix=prefix)
    return done
