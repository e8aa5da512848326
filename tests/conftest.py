from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("SKYFRAME_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.fixture(scope="session")
def same():
    """Compares two frames without order."""

    def check(a: pd.DataFrame, b: pd.DataFrame) -> None:
        assert sorted(a.columns) == sorted(b.columns)
        k = sorted(a.columns)
        a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)

    return check
