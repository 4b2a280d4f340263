"""The run's report and its exit code; a scan's report in its order; the fitted junk score on small tables."""

from pyspark.sql import functions as F
from test_flow import sources

from vigilake.operators import audit, design, policy, scan, workflow
from vigilake.plans.flow import RUN_AT, exit_code, flow_states, outcomes, run_flow, run_report
from vigilake.sources.store import save


def test_run_report(spark):
    flow = run_flow(sources(spark))
    done = save(outcomes(flow), "outcomes")
    flows = flow_states(done).select("flow_id", "status", F.lit("soc_investigation").alias("flow_type"), F.lit("t").alias("title"))
    chains = save(audit.chained(workflow.events(workflow.records(done), flows, policy.ACTOR, RUN_AT)), "chains")
    report = save(run_report(flow, audit.chain_state(chains)), "report")
    got = {(r.part, r.name): r.value for r in report.collect()}
    assert (got["summary", "alerts"], got["summary", "incidents"], got["group", "AG-0001"]) == ("4", "1", "escalate 0.85 INC-0001 AC-7 AP-0001 DENY APPROVAL_REQUIRED")
    assert {v for (part, _), v in got.items() if part == "check"} == {"PASS"} and sum(part == "check" for part, _ in got) == 9 and exit_code(report) == 0
    forged = chains.withColumn("actor", F.when(F.col("seq") == 2, "intruder").otherwise(F.col("actor")))
    broken = save(run_report(flow, audit.chain_state(forged)), "report")
    assert [r.name for r in broken.where("value = 'FAIL'").collect()] == ["every audit chain is intact"] and exit_code(broken) == 1


def test_report_is_read_in_its_order(spark, tmp_path):
    texts = [(f"f{i:03d}", f'password: "hunter2hunter{i}"\nmail a{i}@corp.org and b{i}@corp.org' if i % 3 else f"mail a{i}@corp.org") for i in range(200)]
    found = scan.findings(spark.createDataFrame(texts, "location string, text string").repartition(7))
    schema = scan.report(found).schema
    scan.write_report(found, f"file://{tmp_path}/report")
    again = scan.read_report(spark, f"file://{tmp_path}/report", schema).orderBy("position").collect()
    assert [r.position for r in again] == list(range(1, len(again) + 1)) and all(r.in_order for r in again)
    order = {"HIGH": 0, "MEDIUM": 1, "INFO": 2}
    keys = [(order[r.severity], r.location, r.line) for r in again]
    assert keys == sorted(keys) and len(keys) == found.count()
    found.orderBy(F.desc("location")).coalesce(1).write.json(f"file://{tmp_path}/wrong")
    assert scan.read_report(spark, f"file://{tmp_path}/wrong", schema).where("not in_order").count() > 100
    assert (scan.exit_code(found, "high"), scan.exit_code(found.where("severity = 'MEDIUM'"), "high"), scan.exit_code(found, "never")) == (1, 0, 0)


def test_fitted_score(spark):
    rows = [(True, 1, 5), (True, 1, 6), (True, 2, 5), (False, 2, 9), (False, 3, 9), (False, 3, 9), (False, 3, 8)]
    train = spark.createDataFrame(rows, "expected boolean, a int, b int")
    weights = design.fitted(train, ("a", "b"))
    assert {r.predicted for r in design.scored(train.where("expected"), weights).collect()} == {True}
    assert {r.predicted for r in design.scored(train.where("not expected"), weights).collect()} == {False}
    assert [r.predicted for r in design.scored(spark.createDataFrame([(99, None)], "a int, b int"), weights).collect()] == [False]  # nothing known: the odds alone
    none = design.scored(train.limit(1), design.fitted(train.limit(0), ("a", "b")))
    assert [r.score for r in none.collect()] == [0.0]
    steps = spark.createDataFrame([(None,), ("",), ("the the cat",), ("#$% 12",)], "text string").select(*(x.alias(k) for k, x in design.text_features(F.col("text")).items())).collect()
    assert [tuple(r) for r in steps] == [(-1, -1, -1), (-1, -1, -1), (20, 3, 13), (3, 2, 20)]
