"""The model-backed agent: fitted the same as by plain gradient descent, null-safe, resolved by version."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vigilake.operators import model_agent, triage
from vigilake.plans import operations

GROUP = "group_no long, group_id string, dedup_key string, signature string, asset_id string, severity string, count int, evidence_count long, first_seen string, last_seen string, risk_score int, risk_band string"


def groups(spark, n=600):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        severity, count = ("low", "medium", "high")[rng.integers(3)], int(rng.integers(1, 12))
        score = {"low": 20, "medium": 45, "high": 70}[severity] + 5 * min(count, 5)
        rows.append((i + 1, f"AG-{i + 1}", f"k{i}", f"sig{i % 5}", "a", severity, count, 1 + i % 3, "2026-07-06T21:10:15Z", "2026-07-06T21:20:15Z", score, "high" if score >= 60 else "medium"))
    return spark.createDataFrame(rows, GROUP)


def test_model_agrees_with_the_decisions_that_it_was_fitted_to(spark):
    df = groups(spark)
    decided = df.withColumn("disposition", F.when(F.col("risk_score") >= 60, "escalate").otherwise("monitor"))
    agent = model_agent.fit_agent(decided.repartition(5), "1", sample=300)
    assert agent == model_agent.fit_agent(decided.coalesce(1), "1", sample=300)  # whatever the partitioning
    found = triage.triage(df, agent)
    right = found.join(decided.select("group_id", F.col("disposition").alias("want")), "group_id").where("disposition = want").count()
    assert right >= 0.97 * 600 and set(triage.triage(df).columns) == set(found.columns)
    runs = triage.agent_runs(found, "t", agent).select("agent_name", "agent_version").distinct().collect()
    assert [tuple(r) for r in runs] == [("soc.model", "1")]


def test_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 3))])
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ np.array([0.5, 2, -1, 0])))).astype(float)
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.01 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + model_agent.RIDGE * len(y) * w)
    assert np.allclose(model_agent._fit(x, y), w, atol=1e-4)


def test_nulls_and_nothing(spark):
    df = groups(spark, 60)
    decided = df.withColumn("disposition", F.lit("escalate"))
    agent = model_agent.fit_agent(decided, "2")  # one kind of decision
    nothing = spark.createDataFrame([(1, "AG-1", "k", None, None, None, None, None, None, None, None, None), (2, "AG-2", "k", "new", "a", "odd", 3, 2, "not a time", "", 10, None), (3, "AG-3", "k", "sig1", "a", "high", 9, 0, "", "", 90, "critical")], GROUP)
    got = {r.group_no: (r.disposition, r.confidence) for r in triage.triage(nothing, agent).collect()}
    assert got[1] == ("monitor", 0.3) and got[2][0] == "escalate" and got[3] == ("monitor", 0.3)  # without evidence nothing is escalated
    empty = model_agent.fit_agent(decided.limit(0), "3")
    assert {r.disposition for r in triage.triage(df, empty).collect()} == {"monitor"}
    assert triage.triage(df.limit(0), agent).collect() == []
    registry = model_agent.Registry(triage.resolve("soc.triage"), agent, empty)
    assert registry.resolve("soc.model").version == "3" and registry.resolve("soc.model", "2") is agent and registry.resolve("soc.triage").version == "0.2.0"
    for bad in (lambda: registry.resolve("soc.model", "9"), lambda: registry.resolve("x")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        registry.add(agent)
    assert model_agent._matrix(pa.array([], pa.struct([("severity", pa.string()), ("count", pa.float64()), ("score", pa.float64()), ("evidence", pa.float64()), ("span", pa.float64()), ("signature", pa.string())]))).shape[0] == 0


def test_query(spark):
    got = operations.model_triage(spark, DATA).collect()
    total, right = sum(r.groups for r in got), sum(r.groups for r in got if r.expected == r.predicted)
    assert total == 154 and right >= 0.95 * total
