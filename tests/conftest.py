"""One local session for all tests; the DuckDB comparison."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows(spark):
    """Fails unless a Spark query and its SQL return the same rows over a folder of tables."""
    import duckdb

    def held(query, sql: str, folder: Path) -> None:
        con = duckdb.connect()
        for t in TABLES:
            if (folder / f"{t}.parquet").exists():
                con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        theirs = con.sql(sql)
        ours = query(spark, str(folder)).toArrow()
        names = sorted(ours.column_names)
        assert names == sorted(theirs.columns)
        key = lambda row: tuple((v is not None, str(v)) for v in row)
        mine = sorted(zip(*(ours[n].to_pylist() for n in names), strict=True), key=key)
        other = theirs.to_arrow_table()
        other = sorted(zip(*(other[n].to_pylist() for n in names), strict=True), key=key)
        assert len(mine) == len(other)
        for a, b in zip(mine, other, strict=True):
            assert a == b
        con.close()

    return held
