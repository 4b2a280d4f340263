"""Every query against its SQL twin; the entry point; the stream against the batch."""

import pytest
from conftest import DATA

import __spark_entry__
from vigilake.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_queries_without_a_twin(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"model_triage"}  # tests/test_model_agent.py


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, tmp_path):
    from vigilake.sources import raw
    from vigilake.streaming import alerts

    events = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'error'")
    folder = tmp_path / "in"
    raw.event_sources(events).selectExpr("decode(data, 'UTF-8') AS value").write.text(str(folder))
    batch = alerts.counted(alerts.auth_events(spark.read.text(str(folder)).withColumnRenamed("value", "line")))
    stream = alerts.counted(alerts.auth_stream(spark, str(folder)))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect())) != []
    assert alerts.sessions(alerts.auth_events(spark.read.text(str(folder)).withColumnRenamed("value", "line"))).count() > 0
