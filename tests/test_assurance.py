"""Assurance operators, scope rules by key, histories, long chains and large groups on small inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vigilake.operators import assurance, audit, design, grouping, policy, scan
from vigilake.plans.flow import RUN_AT
from vigilake.sources import store


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_scope_rules_by_key_agree_with_the_expression(spark):
    values = ["10.1.2.3", "10.1.2.4", "A.Example.com.", "example.com", "evilexample.com", "web-01", "https://a.example.org/x", "https://a.example.org", "300.1.1.1", "", "b.net", "net"]
    rules = [("platform_deny", "cidr", "10.1.2.4/31", False), ("scope_allow", "cidr", "10.0.0.0/8", False), ("scope_allow", "domain", "Example.com", True), ("scope_deny", "host", "WEB-01.", False), ("scope_allow", "url_prefix", "https://a.example.org/", False), ("tenant_deny", "domain", "net", None), ("scope_allow", "ip", "10.1.2.3", False), ("nowhere", "host", "net", False), ("scope_allow", "cidr", "bad/99", False)]
    df = spark.createDataFrame(rules, "layer string, kind string, value string, include_apex boolean")
    targets = spark.createDataFrame([(v,) for v in values] + [("web-01",), (None,)], "target string")
    got = {r.target: (r.layer, r.verdict) for r in design.scope_verdict(targets, df).collect()}
    fits = design.typed_match(F.col("target"), F.col("kind"), F.col("value"), F.coalesce("include_apex", F.lit(False)))
    for v in values:
        known = [r.layer for r in targets.where(F.col("target") == v).distinct().crossJoin(df.where("value <> 'bad/99'")).where(fits).collect() if r.layer in design.LAYERS]
        layer = min(known, key=design.LAYERS.index, default=None)
        assert got[v] == (layer, "allow" if layer == "scope_allow" else "deny")
    assert got[None] == (None, "deny") and design.scope_verdict(targets, df).count() == len(values) + 2
    tagged = spark.createDataFrame([("x", ["Prod"]), ("x", ["dev"]), ("2001:DB8::1", None), ("2001:db8:0:0:0:0:0:2", [])], "target string, tags array<string>")
    more = spark.createDataFrame([("scope_allow", "tag", "prod", False), ("scope_allow", "ip", "2001:db8:0::0:1", False), ("tenant_deny", "ip", "2001:db8::2", False)], "layer string, kind string, value string, include_apex boolean")
    assert [r.layer for r in design.scope_verdict(tagged, more).orderBy("target", "tags").collect()] == ["scope_allow", "tenant_deny", "scope_allow", None]


def test_metrics_of_nothing_are_null(spark):
    none = spark.createDataFrame([], "expected string, predicted string, expected_priority string, priority string, alerts long")
    assert all(r.value is None for r in assurance.soc_metrics(none).collect())
    results = spark.createDataFrame([(2, 0.9, "escalate", False), (0, 0.3, "monitor", False)], "evidence_count long, confidence double, disposition string, confirmed boolean")
    got = dict(map(tuple, assurance.ai_metrics(results, spark.createDataFrame([("E1",), ("E9",)], "evidence_id string"), spark.createDataFrame([("E1",)], "evidence_id string")).collect()))
    assert got == {"evidence_grounding_rate": 0.5, "hallucinated_claim_rate": 0.5, "low_confidence_rate": 0.5, "skeptic_disagreement_rate": 1.0}
    stops = assurance.error_stops(spark.createDataFrame([("a", False)] * 98 + [("a", True)] * 2 + [("b", False)] * 97 + [("b", True)] * 3 + [("c", None)], "target string, error boolean"))
    assert {r.target: r.stop for r in stops.collect()} == {"a": False, "b": True, "c": True}


def test_conflicts_keep_the_originals(spark):
    data = [("T1", "a", "escalate", 0.9, ["E1", "E2"]), ("T1", "b", "monitor", 0.9, ["E1"]), ("T2", "a", "escalate", 0.9, ["E1"]), ("T2", "b", "monitor", 0.2, ["E1"]), ("T3", "a", "monitor", 0.9, []), ("T3", "b", "monitor", 0.1, None)]
    every = spark.createDataFrame(data, "task string, agent string, disposition string, confidence double, evidence_ids array<string>")
    results, claims = every.drop("evidence_ids"), every.select("task", "agent", F.explode("evidence_ids").alias("evidence_id"))
    got = {r.task: r for r in assurance.agent_conflicts(results, claims).collect()}
    assert set(got) == {"T1", "T2"} and got["T1"].decision == "review" and got["T2"].decision == "escalate"
    assert (got["T1"].common_evidence, got["T1"].disputed_evidence) == (1, 1) and [r.disposition for r in got["T1"].results] == ["escalate", "monitor"]
    assert rows(assurance.disputes(results, claims)) == rows(spark.createDataFrame([("T1", "E1", 2, True), ("T1", "E2", 1, False), ("T2", "E1", 2, True)], "task string, evidence_id string, agents int, common boolean"))


def test_nulls_are_never_a_pass(spark):
    checks = spark.createDataFrame([(True, True, True, 1, 2, 1, True, "allow"), (None,) * 8, (True, True, True, None, 2, 1, True, "allow"), (True, True, True, 1, 2, 1, True, None)], "in_allowlist boolean, in_scope boolean, in_window boolean, level int, safety_level int, rate_limit int, tool_registered boolean, policy_effect string")
    assert [r.verdict for r in assurance.check_verdicts(checks).collect()] == ["ok", "target_not_allowed", "level_too_high", "policy"]
    candidate = spark.createDataFrame([(1, "k", None, True, 1.0, False, None, None), (2, "m", True, True, None, False, None, None), (3, "n", True, True, 0.9, None, None, None), (4, "n", True, True, 0.9, False, "approved", None)], "candidate_id long, content_key string, source_ok boolean, schema_ok boolean, confidence double, lab_only boolean, decision string, expires_on date")
    assert {r.candidate_id: (r.state, r.reason) for r in assurance.promoted(candidate, "2026-01-01").collect()} == {1: ("rejected", "source"), 2: ("review", "confidence"), 3: ("review", "lab_only"), 4: ("rejected", "duplicate")}
    requests = spark.createDataFrame([("R1", "S1"), ("R2", "S9"), ("R3", None)], "request_id string, scope_id string").withColumns({"actor": F.lit("ops"), "risk_level": F.lit("low"), "target": F.lit("web-01"), "has_approval": F.lit(True), "at": F.lit(RUN_AT)})
    scope = policy.bound(spark.createDataFrame([("S1", 1, True, 3, ["ops"], ["web-01"], None, None)], policy.SCOPE))
    assert {r.request_ref: r.effect for r in policy.decide(requests, scope, RUN_AT).collect()} == {"R1": "allow", "R2": "deny", "R3": "deny"}


def test_history_and_thresholds(spark):
    texts = spark.createDataFrame([("a", 1, "mail x@corp.org"), ("b", 1, "y" * 90), ("b", 2, "mail z@corp.org")], "history string, seq long, text string")
    got = scan.history_findings(texts, 100)
    assert [(r.severity, r.rule, r.location, r.seq) for r in got.orderBy("location").collect()] == [("MEDIUM", "email-address", "history:a", 1), ("INFO", "history-scan-skipped", "history:b", None)]
    assert {r.fail_on: r.failed for r in scan.threshold(got).collect()} == {"high": False, "medium": True, "never": False}


def test_guards_miss_nothing(spark):
    samples = ["-----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 20, "github_pat_" + "a" * 20, "ASIA" + "A" * 16, "sk-" + "a" * 20, "xoxb-" + "1" * 10, "AIza" + "b" * 30, "eyJ" + "a" * 8 + "." + "b" * 8 + "." + "c" * 8, *(f"{w}: hunter2hunter2" for w in ("Password", "PASSWD", "pwd", "secret", "api-key", "APIKEY", "access_token", "AuthToken")), "me@corp.org", "/Users/jane/", "C:\\Users\\jane\\", "10.0.0.1", "192.168.1.1", "172.20.1.1"]
    found = scan.findings(spark.createDataFrame([(str(i), x) for i, x in enumerate(samples)], "location string, text string"))
    assert {r.location for r in found.collect()} == {str(i) for i in range(len(samples))}


def test_long_chain_and_tampering(spark):
    events = spark.range(3000).select(F.when(F.col("id") < 2990, "A").otherwise("B").alias("chain_id"), F.col("id").alias("seq"), F.lit("ops").alias("actor"), F.lit("t").alias("event_type"), F.when(F.col("id") % 2 == 0, "F").alias("flow_id"), F.lit(None).cast("string").alias("subject_ref"), F.lit('{"é":1}').alias("payload"), F.lit(RUN_AT).alias("recorded_at"))
    chain = store.save(audit.chained(events.repartition(7)), "chain")
    assert {r.chain_id: (r.intact, r.events) for r in audit.chain_state(chain).collect()} == {"A": (True, 2990), "B": (True, 10)}
    first = chain.where("seq = 0").first()
    body = f'{{"actor":"ops","event_id":"AUD-0001","event_type":"t","flow_id":"F","payload":{{"é":1}},"prev_hash":"{audit.GENESIS}","recorded_at":"{RUN_AT}","subject_ref":null}}'
    assert first.entry_hash == "sha256:" + hashlib.sha256(body.encode()).hexdigest()
    forged = chain.withColumn("payload", F.when(F.col("seq") == 1500, "{}").otherwise(F.col("payload")))
    assert {r.chain_id: r.first_broken for r in audit.chain_state(forged).collect()} == {"A": 1500, "B": None}


def test_large_groups_keep_all_evidence(spark):
    n = grouping.LISTED + 50
    alerts = spark.range(1, n + 3).select(F.when(F.col("id") <= n, "k").otherwise("small").alias("dedup_key"), F.col("id").alias("seq"), F.concat(F.lit("ALERT-"), F.col("id").cast("string")).alias("alert_id"), F.array(F.concat(F.lit("EVID-"), F.col("id").cast("string"))).alias("evidence_ids"), F.lit("s").alias("signature"), F.lit("a").alias("asset_id"), F.lit("low").alias("severity"), F.lit("t").alias("event_time"))
    groups = store.save(grouping.group(alerts), "groups")
    got = {r.dedup_key: r for r in grouping.with_lists(groups, alerts).collect()}
    assert (got["k"]["count"], got["k"].evidence_count, got["k"].alert_ids, got["k"].evidence_ids) == (n, n, None, None)
    assert (got["small"].alert_ids, got["small"].evidence_ids) == ([f"ALERT-{n + 1}", f"ALERT-{n + 2}"], [f"EVID-{n + 1}", f"EVID-{n + 2}"])
    assert grouping.evidence(alerts).where("dedup_key = 'k'").count() == n
    assert [r.place for r in grouping.members(alerts).where("dedup_key = 'k'").orderBy("seq").collect()] == list(range(1, n + 1))


def test_a_package_is_hashed_over_all_its_evidence(spark):
    n = 2500
    of = spark.range(1, n + 1).select(F.lit("INC-1").alias("incident_id"), F.format_string("EVID-%04d", "id").alias("evidence_id"))
    evidence = of.where("evidence_id <> 'EVID-0003'").select("evidence_id", F.concat(F.lit("sha256:"), F.sha2("evidence_id", 256)).alias("content_hash"))
    lines = assurance.evidence_lines(of, evidence)
    h = lambda x: "sha256:" + hashlib.sha256(x.encode()).hexdigest()
    want = [f"{e}={'missing' if e == 'EVID-0003' else h(e)}" for e in (f"EVID-{i:04d}" for i in range(1, n + 1))]
    want = h(h(",".join(h(",".join(want[a:b])) for a, b in ((0, 999), (999, 1999), (1999, n)))))
    row = assurance.evidence_digests(lines.repartition(5)).first()
    assert (row.n_evidence, row.evidence_digest) == (n, want)
    package = spark.createDataFrame([("INC-1", row.evidence_digest), ("INC-2", None)], "incident_id string, evidence_digest string")
    assert {r.incident_id: r.intact for r in assurance.checked_package(package, lines).collect()} == {"INC-1": True, "INC-2": True}
    assert {r.incident_id: r.intact for r in assurance.checked_package(package, lines.where("evidence_no <> 2400")).collect()} == {"INC-1": False, "INC-2": True}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(RuntimeError):
        store.scratch_root(Session)


def test_uploads_and_package(spark, tmp_path):
    got = assurance.uploads(spark.createDataFrame([("A.TXT", b"x"), ("b.exe", b"x"), ("c.md", b""), ("d.pdf", None), ("e.json", b"x" * 20), (None, b"x")], "name string, data binary"), 10)
    assert {r.name: r.refused for r in got.collect()} == {"A.TXT": None, "b.exe": "media_type", "c.md": "empty", "d.pdf": "empty", "e.json": "too_large", None: "media_type"}
    facts = spark.createDataFrame([("T", 'Attack Step: probe\nrisk statement :  loss ')], "id string, text string")
    r = assurance.knowledge(facts).first()
    assert (r.attack_step, r.risk_statement, r.validation_check, r.complete, r.lab_only, r.production_validated) == ("probe", "loss", None, False, True, False)


def test_stop_condition_on_a_stream(spark, tmp_path):
    """The same rates as a batch, kept by target while files arrive."""
    schema = "target string, error boolean"
    spark.createDataFrame([("a", i == 0) for i in range(20)] + [("b", False)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = assurance.error_stops(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("stops").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.target: (r.errors, r.stop) for r in spark.table("stops").collect()} == {"a": (1, True), "b": (0, False)}
