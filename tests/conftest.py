"""A session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import decimal
import math
import os
import sys
import tempfile
from collections import Counter
from collections.abc import Callable

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.local.dir": folder,
        "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck() -> Callable[[str], duckdb.DuckDBPyConnection]:
    """A connection with the tables of a folder as views."""

    def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in TABLES.split():
            path = f"{sf_dir}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
        return con

    return connect


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="session")
def same_rows(duck) -> Callable[[DataFrame, str, str], None]:
    """Asserts that a DataFrame has the rows of a SQL text over the tables of a folder."""

    def check(df: DataFrame, sql: str, sf_dir: str) -> None:
        found = duck(sf_dir).execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = Counter(tuple(map(plain, r)) for r in found.fetchall())
        got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
