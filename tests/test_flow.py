"""The behaviours of the flow on two small sources: counts, scores, policy gates, tampering, replay."""

import pytest
from pyspark.sql import functions as F

from vigilake.functions.text import content_hash, lines
from vigilake.operators import audit, collections_, design, grouping, normalize, policy, remediation, replay, scan, triage, workflow
from vigilake.plans.flow import COLLECTIONS, RUN_AT, flow_states, invariants, outcomes, run_flow
from vigilake.sources import raw

AUTH = b"""Jul  6 21:10:15 web-01 sshd[11]: Failed password for root from 198.51.100.23 port 51 ssh2
Jul  6 21:10:18 web-01 sshd[12]: Failed password for root from 198.51.100.23 port 52 ssh2
Jul  6 21:10:19 web-01 sshd[12]: Failed password for invalid user bob from 198.51.100.23 port 52 ssh2
Jul  6 21:10:22 web-01 sshd[13]: Failed password for root from 198.51.100.23 port 53 ssh2
"""
EVE = b"""
{"timestamp":"2026-07-06T21:10:00.000000+0000","event_type":"alert","src_ip":"192.0.2.10","dest_ip":"203.0.113.10","alert":{"severity":2,"signature":"Odd TLS","signature_id":1000001}}
{"timestamp":"2026-07-06T21:11:00.000000+0000","event_type":"flow","src_ip":"192.0.2.10"}
"""
SOURCE = "name string, source_type string, media_type string, source_ord int, file_no long, data binary"


def sources(spark, auth=AUTH, eve=EVE):
    return spark.createDataFrame([("auth.log", "linux_auth", "text/plain", 0, 0, bytearray(auth)), ("eve.json", "suricata_eve", "application/x-ndjson", 1, 0, bytearray(eve))], SOURCE)


@pytest.fixture(scope="module")
def flow(spark):
    return run_flow(sources(spark))


@pytest.fixture(scope="module")
def chains(spark, flow):
    done = outcomes(flow)
    flows = flow_states(done).select("flow_id", "status", F.lit("soc_investigation").alias("flow_type"), F.lit("t").alias("title"))
    return audit.chained(workflow.events(workflow.records(done), flows, policy.ACTOR, RUN_AT)).cache()


def test_ingest_groups_and_scores(flow):
    assert (flow.evidence.count(), flow.alerts.count()) == (2, 4)
    ssh, tls = flow.alert_groups.orderBy("group_no").collect()
    assert (ssh.group_id, ssh.dedup_key, ssh["count"], ssh.severity, ssh.risk_score, ssh.risk_band) == ("AG-0001", "ssh_failed_password:web-01:198.51.100.23", 3, "medium", 70, "high")
    assert (tls["count"], tls.severity, tls.risk_score, tls.risk_band, tls.evidence_count) == (1, "medium", 50, "medium", 1)
    listed = grouping.with_lists(flow.alert_groups, flow.alerts).where("group_no = 2").first()
    assert (listed.alert_ids, listed.evidence_ids) == (["ALERT-0004"], ["EVID-0002"])
    assert sorted(map(tuple, flow.group_evidence.collect())) == [("AG-0001", "EVID-0001"), ("AG-0002", "EVID-0002")]
    assert (ssh.first_seen, ssh.last_seen) == ("2026-07-06T21:10:15Z", "2026-07-06T21:10:22Z")
    assert tls.first_seen == "2026-07-06T21:10:00.000000Z"


def test_end_to_end(flow):
    incident = flow.incidents.first()
    assert (flow.incidents.count(), incident.title, incident.attack_techniques) == (1, "ssh_failed_password on web-01", ["T1110"])
    assert flow.control_mappings.first().control_id == "AC-7"
    assert flow.risks.first().inherent_band == "medium"
    plan, decision = flow.action_plans.first(), flow.policy_decisions.first()
    assert (plan.action_type, plan.status, plan.requires_approval) == ("harden_ssh_access", "proposed", True)
    assert (decision.effect, decision.reason_code) == ("deny", "APPROVAL_REQUIRED")
    state = flow_states(outcomes(flow)).first()
    assert (state.status, state.related_incident_id) == ("waiting_for_approval", "INC-0001")


def test_audit_chain_and_tampering(flow, chains):
    assert chains.count() == 19
    assert dict(chains.groupBy("event_type").count().collect()) == {"flow.started": 1, "task.started": 5, "step.ran": 6, "tool.called": 5, "policy.decision": 1, "flow.status_changed": 1}
    assert audit.chain_state(chains).first().intact
    assert all(r.passed for r in invariants(flow, audit.chain_state(chains)).collect())
    for c in (*audit.FIELDS, "prev_hash", "entry_hash"):
        forged = chains.withColumn(c, F.when(F.col("event_id") == "AUD-0003", F.lit('"x"')).otherwise(F.col(c)))
        assert not audit.chain_state(forged).first().intact, c
    assert not audit.chain_state(chains.where("event_id <> 'AUD-0004'")).first().intact


def test_replay(spark, flow):
    again = run_flow(replay.rebuilt_sources(flow.evidence, raw.vault(flow.evidence)).repartition(3))
    assert all(r.equal for r in replay.compare(flow, again, COLLECTIONS).collect())
    other = run_flow(sources(spark, AUTH.replace(b"root", b"ruut")))
    assert not all(r.equal for r in replay.compare(flow, other, COLLECTIONS).collect())
    with pytest.raises(Exception, match="evidence is damaged"):
        replay.rebuilt_sources(flow.evidence, raw.vault(flow.evidence).withColumn("data", F.lit("x").cast("binary"))).collect()


def test_bad_input_is_an_error(spark):
    with pytest.raises(Exception, match="no parser"):
        raw.checked_sources(spark.createDataFrame([("x", "syslog", "", 0, 0, bytearray(b""))], SOURCE)).collect()
    for eve in (b"{not json", b'{"event_type":"alert","src_ip":null}', b'{"event_type":"alert","alert":{"severity":"x"}}'):
        with pytest.raises(Exception):
            run_flow(sources(spark, eve=eve)).alerts.count()
    got = run_flow(sources(spark, eve=b'{"event_type":"alert","dest_ip":null}')).alerts.where("source = 'suricata_eve'").first()
    assert (got.dedup_key, got.title, got.severity) == ("suspicious_outbound_tls:0:unknown:None", "Suricata alert", "low")


def test_lines_split_as_splitlines(spark):
    for text in ("", "a", "a\n", "a\r\nb\rc\n\nd", "x\x0by\x0cz\x1c1\x1d2\x1e3\x854 5 6", "\n"):
        got = spark.createDataFrame([(text,)], "t string").select(lines(F.col("t")).alias("l")).first().l
        assert got == text.splitlines()


BASE = dict(actor="security-operator", risk_level="medium", target="web-01", has_approval=True, at="2026-07-06T21:15:00Z")
SCOPE = dict(scope_version=1, approved=True, autonomy_level=3, allowed_actors=["security-operator"], target_allowlist=["web-01", "*.example.internal"], valid_from="2026-07-01T00:00:00Z", valid_until="2026-12-31T00:00:00Z")
GATES = [
    ({}, {}, "ALLOW_OK"), ({}, {"approved": False}, "SCOPE_NOT_APPROVED"), ({}, {"approved": None}, "SCOPE_NOT_APPROVED"), ({"at": None}, {}, "SCOPE_WINDOW_INVALID"), ({"at": "2026-06-30T00:00:00Z"}, {}, "SCOPE_WINDOW_INVALID"), ({}, {"valid_until": "2026-07-01T00:00:00Z"}, "SCOPE_EXPIRED"),
    ({"at": "2026-07-01T00:00:00Z"}, {}, "ALLOW_OK"), ({}, {"valid_from": "", "valid_until": None}, "ALLOW_OK"), ({"actor": "intruder"}, {}, "ACTOR_NOT_PERMITTED"), ({"actor": None}, {}, "ACTOR_NOT_PERMITTED"), ({}, {"allowed_actors": []}, "ACTOR_NOT_PERMITTED"), ({"target": "db-99"}, {}, "TARGET_NOT_IN_SCOPE"),
    ({"target": "host.example.internal"}, {}, "ALLOW_OK"), ({"target": "evil-example.internal"}, {}, "TARGET_NOT_IN_SCOPE"), ({"target": "example.internal"}, {}, "TARGET_NOT_IN_SCOPE"), ({"target": None}, {}, "TARGET_NOT_IN_SCOPE"), ({"has_approval": False}, {}, "APPROVAL_REQUIRED"), ({"has_approval": None}, {}, "APPROVAL_REQUIRED"),
    ({"risk_level": None, "has_approval": False}, {}, "APPROVAL_REQUIRED"), ({"risk_level": "low", "has_approval": False}, {"autonomy_level": 1}, "AUTONOMY_LEVEL_INSUFFICIENT"), ({"risk_level": "low", "has_approval": False}, {"autonomy_level": 4}, "ALLOW_OK"), ({}, {"autonomy_level": None}, "AUTONOMY_LEVEL_INSUFFICIENT"),
]


def test_policy_gates(spark):
    claims = '{"pre_approved":true,"ignore_policy":true}'
    for k, (request, scope, code) in enumerate(GATES):
        r, s = BASE | request, SCOPE | scope
        requests = spark.createDataFrame([(f"R{k}", r["actor"], r["risk_level"], r["target"], r["has_approval"], r["at"], claims)], "request_id string, actor string, risk_level string, target string, has_approval boolean, at string, claimed string")
        scopes = policy.bound(spark.createDataFrame([("S", *(s[c] for c in ("scope_version", "approved", "autonomy_level", "allowed_actors", "target_allowlist", "valid_from", "valid_until")))], policy.SCOPE))
        got = policy.decide(requests, scopes, RUN_AT).first()
        assert (got.reason_code, got.effect) == (code, "allow" if code == "ALLOW_OK" else "deny"), (request, scope)
        assert got.policy_hash.startswith("sha256:")
    unbound = policy.decide(requests, scopes.withColumn("policy_hash", F.lit("")), RUN_AT).first()
    assert unbound.reason_code == "SCOPE_UNBOUND"


def test_policy_hash_follows_what_decides(spark):
    def of(**changes):
        s = SCOPE | changes
        return policy.bound(spark.createDataFrame([("S", *(s[c] for c in ("scope_version", "approved", "autonomy_level", "allowed_actors", "target_allowlist", "valid_from", "valid_until")))], policy.SCOPE)).first().policy_hash

    base = of()
    assert of(approved=False) == base and of(target_allowlist=["*.example.internal", "web-01"]) == base
    assert base not in {of(autonomy_level=4), of(scope_version=2), of(valid_until=None), of(allowed_actors=["x"])}


def test_triage_rules(spark):
    rows = [(1, "ssh_failed_password", "low", 3, 1), (2, "ssh_failed_password", "high", 2, 1), (3, "other", "medium", 9, 1), (4, "ssh_failed_password", "critical", 9, 0), (5, "suspicious_outbound_tls", "critical", 1, 1)]
    groups = spark.createDataFrame(rows, "group_no long, signature string, risk_band string, count int, evidence_count long").withColumns({"group_id": F.lit("AG"), "asset_id": F.lit("a"), "severity": F.lit("low")})
    got = {r.group_no: (r.disposition, r.confidence, list(r.recommended_action_types), list(r.attack_techniques)) for r in triage.triage(groups).collect()}
    assert got == {1: ("escalate", 0.85, ["harden_ssh_access"], ["T1110"]), 2: ("escalate", 0.7, [], ["T1110"]), 3: ("monitor", 0.6, [], []), 4: ("monitor", 0.3, [], ["T1110"]), 5: ("escalate", 0.7, [], ["T1071.001"])}
    assert {r.group_no for r in triage.incidents(triage.triage(groups), RUN_AT).collect()} == {1, 2, 5}
    assert remediation.action_plans(triage.incidents(triage.triage(groups), RUN_AT), RUN_AT).count() == 1
    with pytest.raises(KeyError):
        triage.resolve("soc.triage", "9")
    assert set(normalize.PARSERS) == set(raw.ORDER)


def test_order_of_partitions_does_not_matter(spark, duck):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a, b = (run_flow(raw.event_sources(events.repartition(n))) for n in (1, 5))
    assert all(r.equal for r in replay.compare(a, b, COLLECTIONS).collect())


def test_scan_and_merge(spark):
    texts = spark.createDataFrame([("f", 'ok\npassword: "hunter2hunter2"\npassword=required\nsee example.com AKIA' + "A" * 16 + "\nAKIA" + "B" * 16), ("g", None)], "location string, text string")
    found = scan.report(scan.findings(texts)).collect()
    assert [(r.severity, r.rule, r.line) for r in found] == [("HIGH", "credential-assignment", 2), ("HIGH", "aws-access-key", 5)]
    assert scan.counts(scan.findings(texts)).first().asDict() == {"high": 2, "medium": 0, "info": 0}
    old, new = (spark.createDataFrame(x, "k int, v string, s int") for x in ([(1, "a", 1)], [(1, "b", 2), (2, "c", 4), (2, "d", 3)]))
    once = collections_.merge_keep(old, new, "k", "s")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 3)] == sorted(map(tuple, collections_.merge_keep(once, new, "k", "s").collect()))
    assert spark.range(1).select(content_hash(F.lit("a").cast("binary"))).first()[0] == "sha256:ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"


def test_typed_targets(spark):
    def fits(target, kind, value, apex=False):
        return spark.range(1).select(design.typed_match(F.lit(target), F.lit(kind), F.lit(value), F.lit(apex))).first()[0]

    assert fits("10.1.2.3", "cidr", "10.0.0.0/8") and not fits("11.1.2.3", "cidr", "10.0.0.0/8") and not fits("x", "cidr", "10.0.0.0/8") and fits("1.2.3.4", "cidr", "0.0.0.0/0")
    assert fits("A.Example.com.", "domain", "example.com") and not fits("example.com", "domain", "example.com") and fits("example.com", "domain", "example.com", True) and not fits("evilexample.com", "domain", "example.com", True)
    assert fits("300.1.1.1", "ip", "300.1.1.1") is False
