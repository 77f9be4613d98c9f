from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


@pytest.fixture(scope="session")
def spark():
    from threadline import build_session

    session = build_session(
        "threadline-tests",
        master="local[*]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in BASE:
        path = f"{DATA}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def make(spark):
    """Small tables: make("a long, b string", (1, "x"), ...)."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build
