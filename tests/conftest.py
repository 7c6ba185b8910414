from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tidemark.session import configure, shared_dir

    session = (SparkSession.builder.master("local[*]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    shared_dir(session)  # tests only: a scratch checkpoint dir when unset
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def fixed_day():
    """The clock stands at the day the oracle's statements name."""
    from datetime import date

    from tidemark import params

    params.today = lambda: date(2025, 8, 1)


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="tidemark-test-")
