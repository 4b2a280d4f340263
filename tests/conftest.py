import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def as_rows(columns, rows):
    """Rows as sorted text, columns by name, so that two engines' results can be compared."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in at]) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, DATA)
        got = as_rows(df.columns, [tuple(r) for r in df.collect()])
        res = duck.execute(sql)
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == as_rows(columns, res.fetchall())

    return check
