"""Queries of the assurance operators, of files on disk and of keyed collections, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.text import BUCKET, numbered
from vigilake.operators import assurance, collections_, design, normalize, scan, triage
from vigilake.plans import sql as S
from vigilake.plans.flow import run_flow
from vigilake.sources import raw
from vigilake.sources.store import fresh_path, save

QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flow(spark, d):
    return run_flow(raw.event_sources(_table(spark, d, "events")))


def _text(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


# expected results: every seventh group should have been escalated, every fifth suppressed; single low alerts are suppressed


def _judged(triaged: DataFrame) -> DataFrame:
    n = F.col("group_no")
    predicted = F.when((F.col("count") == 1) & (F.col("severity") == "low"), "suppress").otherwise(F.col("disposition"))
    expected = F.when(n % 7 == 0, "escalate").when(n % 5 == 0, "suppress").otherwise(F.col("disposition"))
    out = triaged.withColumns({"predicted": predicted, "expected": expected, "alerts": F.col("count")})
    return out.withColumns({"priority": design.priority(F.col("predicted"), F.col("confidence")), "expected_priority": design.priority(F.col("expected"), F.lit(0.8) - n % 2 * 0.1)})


_JUDGED = S.TRIAGED + """,
expectations AS (
  SELECT *, CASE WHEN count = 1 AND severity = 'low' THEN 'suppress' ELSE disposition END AS predicted, CASE WHEN group_no % 7 = 0 THEN 'escalate' WHEN group_no % 5 = 0 THEN 'suppress' ELSE disposition END AS expected FROM triaged),
judged AS (
  SELECT *, CASE WHEN predicted = 'escalate' THEN CASE WHEN confidence >= 0.8 THEN 'P0' ELSE 'P1' END WHEN predicted = 'monitor' THEN 'P2' ELSE 'P3' END AS priority,
    CASE WHEN expected = 'escalate' THEN 'P0' WHEN expected = 'monitor' THEN 'P2' ELSE 'P3' END AS expected_priority FROM expectations)"""
_share = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"


def _metrics(source: str, **values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value FROM {source}" for k, v in values.items())


@_query(S.query(_JUDGED, _metrics(
    "judged", triage_accuracy=_share("count(*) FILTER (WHERE expected = predicted)", "count(*)"), false_suppression_rate=_share("count(*) FILTER (WHERE predicted = 'suppress' AND expected <> 'suppress')", "count(*) FILTER (WHERE predicted = 'suppress')"),
    missed_escalation_rate=_share("count(*) FILTER (WHERE expected = 'escalate' AND predicted <> 'escalate')", "count(*) FILTER (WHERE expected = 'escalate')"), urgent_precision=_share("count(*) FILTER (WHERE priority IN ('P0', 'P1') AND expected_priority IN ('P0', 'P1'))", "count(*) FILTER (WHERE priority IN ('P0', 'P1'))"),
    urgent_recall=_share("count(*) FILTER (WHERE priority IN ('P0', 'P1') AND expected_priority IN ('P0', 'P1'))", "count(*) FILTER (WHERE expected_priority IN ('P0', 'P1'))"), duplicate_reduction="round(1 - CAST(count(*) AS DOUBLE) / nullif(sum(count), 0), 6)", alerts_per_incident=_share("sum(count)", "count(*) FILTER (WHERE predicted = 'escalate')"))))
def soc_metrics(spark, d):
    return assurance.soc_metrics(_judged(_flow(spark, d).triaged))


@_query(S.query(S.PLANS + """,
results AS (SELECT *, CASE WHEN group_no % 9 = 0 THEN evidence_ids || ',EVID-none' ELSE evidence_ids END AS claimed, disposition = 'escalate' AND evidence_ids <> '' AND confidence >= 0.5 AS confirmed FROM triaged),
claims AS (SELECT unnest(string_split(claimed, ',')) AS evidence_id FROM results WHERE claimed <> ''),
known AS (SELECT printf('EVID-%04d', evidence_no) AS evidence_id FROM evidence),
executions AS (SELECT o_orderkey % 10 <> 0 AS preflight_ok, o_orderkey % 10 <> 0 AS executed, o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0 AS failed, o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS verified, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0 THEN o_orderkey % 2 = 0 END AS rollback_ok FROM orders)""",
    "SELECT 'ai' AS family, * FROM (" + _metrics("results", evidence_grounding_rate=_share("count(*) FILTER (WHERE claimed <> '')", "count(*)"), low_confidence_rate=_share("count(*) FILTER (WHERE confidence < 0.5)", "count(*)"), skeptic_disagreement_rate=_share("count(*) FILTER (WHERE disposition = 'escalate' AND NOT confirmed)", "count(*) FILTER (WHERE disposition = 'escalate')"))
    + ") UNION ALL SELECT 'ai', 'hallucinated_claim_rate', " + _share("count(*) FILTER (WHERE known.evidence_id IS NULL)", "count(*)") + " FROM claims LEFT JOIN known USING (evidence_id)"
    + " UNION ALL SELECT 'grc', * FROM (" + _metrics("mappings", control_mapping_accuracy=_share("count(*) FILTER (WHERE incident_no % 6 <> 0)", "count(*)"), evidence_sufficiency=_share("count(*) FILTER (WHERE evidence_ids <> '')", "count(*)")) + ")"
    + " UNION ALL SELECT 'grc', 'risk_statement_quality', " + _share("count(*) FILTER (WHERE attack_techniques <> '')", "count(*)") + " FROM incidents"
    + " UNION ALL SELECT 'remediation', * FROM (" + _metrics("executions", preflight_success_rate=_share("count(*) FILTER (WHERE preflight_ok)", "count(*)"), verification_pass_rate=_share("count(*) FILTER (WHERE verified)", "count(*) FILTER (WHERE executed)"), rollback_success_rate=_share("count(*) FILTER (WHERE rollback_ok)", "count(rollback_ok)"), failed_execution_rate=_share("count(*) FILTER (WHERE failed)", "count(*) FILTER (WHERE executed)")) + ")"))
def quality_metrics(spark, d):
    """The families ai, grc and remediation; every ninth result claims evidence that does not exist, every sixth mapping was expected otherwise."""
    f = _flow(spark, d)
    claims = f.group_evidence.select("evidence_id").unionByName(f.triaged.where("group_no % 9 = 0").select(F.lit("EVID-none").alias("evidence_id")))
    ai = assurance.ai_metrics(f.triaged.withColumn("confirmed", triage.may_escalate()), claims, f.evidence)
    number = F.substring_index("incident_id", "-", -1).cast("int")
    grc = assurance.grc_metrics(f.control_mappings.withColumn("expected_control", F.when(number % 6 == 0, "OTHER").otherwise(F.col("control_id"))), f.risks.join(f.incidents.select(F.col("incident_id").alias("related_incident_id"), "asset_id"), "related_incident_id"))
    n = F.col("o_orderkey")
    ran, failed = n % 10 != 0, (n % 10 != 0) & (n % 7 == 0)
    done = _table(spark, d, "orders").select(ran.alias("preflight_ok"), ran.alias("executed"), failed.alias("failed"), (ran & ~failed & (n % 3 != 0)).alias("verified"), F.when(failed, n % 2 == 0).alias("rollback_ok"))
    parts = (("ai", ai), ("grc", grc), ("remediation", assurance.remediation_metrics(done)))
    out = [df.select(F.lit(name).alias("family"), "metric", "value") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("""
SELECT user_id AS target, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 6) AS rate, count(*) FILTER (WHERE event_type = 'error') > 0.02 * count(*) AS stop FROM events GROUP BY user_id""")
def error_rate_stops(spark, d):
    return assurance.error_stops(_table(spark, d, "events").select(F.col("user_id").alias("target"), (F.col("event_type") == "error").alias("error")))


@_query(S.query(S.PLANS + """,
expectations AS (SELECT *, CASE WHEN count = 1 AND severity = 'low' THEN 'suppress' ELSE disposition END AS predicted, CASE WHEN group_no % 7 = 0 THEN 'escalate' WHEN group_no % 5 = 0 THEN 'suppress' ELSE disposition END AS expected FROM triaged)""", """
SELECT 'no urgent alert is suppressed' AS name, count(*) FILTER (WHERE expected = 'escalate' AND predicted = 'suppress') AS violations, count(*) FILTER (WHERE expected = 'escalate' AND predicted = 'suppress') = 0 AS passed FROM expectations
UNION ALL SELECT 'no confirmed incident is missed', count(*) FILTER (WHERE e.predicted <> 'escalate'), count(*) FILTER (WHERE e.predicted <> 'escalate') = 0 FROM expectations e JOIN incidents USING (group_no)
UNION ALL SELECT 'triage refers to evidence', count(*) FILTER (WHERE evidence_ids = ''), count(*) FILTER (WHERE evidence_ids = '') = 0 FROM expectations
UNION ALL SELECT 'suppression rules expire', count(*) FILTER (WHERE s_suppkey % 10 = 3), count(*) FILTER (WHERE s_suppkey % 10 = 3) = 0 FROM supplier
UNION ALL SELECT 'plans can be rolled back', count(*) FILTER (WHERE trim(coalesce(rollback, '')) = ''), count(*) FILTER (WHERE trim(coalesce(rollback, '')) = '') = 0 FROM plans"""))
def safety_thresholds(spark, d):
    """Suppression rules: one for every supplier, of which every tenth has no end."""
    f = _flow(spark, d)
    judged = _judged(f.triaged)
    rules = _table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 != 3, "2027-01-01").alias("expiry"))
    return assurance.safety_checks(judged, judged.join(f.incidents.select("group_id"), "group_id", "left_semi"), rules, f.action_plans)


_SECOND = S.TRIAGED + """,
claims AS (SELECT DISTINCT group_no, evidence_id FROM alerts JOIN groups USING (dedup_key)),
second AS (SELECT t.group_no, t.group_id, CASE WHEN count < 5 THEN 'monitor' ELSE 'escalate' END AS disposition, CAST(CASE WHEN t.group_no % 3 = 0 THEN 0.4 ELSE 0.9 END AS DOUBLE) AS confidence, CASE WHEN t.group_no % 4 > 0 THEN (SELECT min(evidence_id) FROM claims c WHERE c.group_no = t.group_no) END AS evidence FROM triaged t),
both_ AS (SELECT t.group_no, t.group_id AS task, t.disposition AS d1, s.disposition AS d2, t.evidence_ids <> '' AND t.confidence >= 0.5 AS s1, s.evidence IS NOT NULL AND s.confidence >= 0.5 AS s2, t.evidence_ids, s.evidence FROM triaged t JOIN second s USING (group_id) WHERE t.disposition <> s.disposition)"""


def _two_agents(spark, d) -> tuple[DataFrame, DataFrame]:
    """The triage agent against one that only counts, and gives its first piece of evidence for three groups of four: results and claims."""
    f = _flow(spark, d)
    t, n = f.triaged, F.col("group_no")
    view = lambda agent, disposition, confidence: t.select(F.col("group_id").alias("task"), F.lit(agent).alias("agent"), disposition.alias("disposition"), confidence.cast("double").alias("confidence"))
    second = view("counting", F.when(F.col("count") < 5, "monitor").otherwise("escalate"), F.when(n % 3 == 0, 0.4).otherwise(0.9))
    claims = f.group_evidence.select(F.col("group_id").alias("task"), F.lit("triage").alias("agent"), "evidence_id")
    few = claims.join(t.where(n % 4 > 0).select(F.col("group_id").alias("task")), "task", "left_semi").groupBy("task").agg(F.min("evidence_id").alias("evidence_id")).select("task", F.lit("counting").alias("agent"), "evidence_id")
    return view("triage", F.col("disposition"), F.col("confidence")).unionByName(second), claims.unionByName(few)


@_query(S.query(_SECOND, """
SELECT task, CASE WHEN s1 AND NOT s2 THEN d1 WHEN s2 AND NOT s1 THEN d2 ELSE 'review' END AS decision, CASE WHEN s1 <> s2 THEN 'sound-results-agree/1' ELSE 'human' END AS resolver, CAST(evidence IS NOT NULL AS BIGINT) AS n_common,
  (SELECT count(*) FROM claims c WHERE c.group_no = b.group_no) - CAST(evidence IS NOT NULL AS BIGINT) AS n_disputed, coalesce(evidence, '') AS common_evidence, array_to_string(list_filter(string_split(evidence_ids, ','), lambda x: x <> coalesce(evidence, '')), ',') AS disputed_evidence, CAST(evidence IS NULL AS INTEGER) + CAST(evidence_ids = '' AS INTEGER) AS without_evidence, 2 AS n_results FROM both_ b"""))
def agent_conflicts(spark, d):
    results, claims = _two_agents(spark, d)
    found = assurance.agent_conflicts(results, claims).withColumnsRenamed({"common_evidence": "n_common", "disputed_evidence": "n_disputed"}).join(assurance.dispute_lists(results, claims), "task", "left")
    whole = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return found.select("task", "decision", "resolver", "n_common", "n_disputed", whole("common_evidence"), whole("disputed_evidence"), "without_evidence", F.size("results").alias("n_results"))


@_query(S.query(_SECOND, "SELECT task, evidence_id, CASE WHEN evidence_id = evidence THEN 2 ELSE 1 END AS agents, coalesce(evidence_id = evidence, false) AS common FROM both_ JOIN claims USING (group_no)"))
def agent_disputes(spark, d):
    return assurance.disputes(*_two_agents(spark, d))


@_query("""
WITH f AS (SELECT s_suppkey AS finding_id, s_suppkey % 5 AS k FROM supplier),
x AS (SELECT finding_id, CASE k WHEN 0 THEN 'csp' WHEN 1 THEN 'tls' WHEN 2 THEN 'ssh' WHEN 3 THEN 'none' END AS kind FROM f)
SELECT finding_id, kind, CASE kind WHEN 'csp' THEN 'SI-10' WHEN 'tls' THEN 'SC-8' WHEN 'ssh' THEN 'AC-7' END AS control_id, CASE WHEN finding_id % 3 = 0 THEN 'RISK-' || finding_id END AS risk_id, CASE WHEN finding_id % 6 = 0 THEN 'AP-' || finding_id END AS plan_id,
  CASE WHEN finding_id % 6 = 0 THEN 'plan' WHEN finding_id % 3 = 0 THEN 'risk' WHEN kind IN ('csp', 'tls', 'ssh') THEN 'control' ELSE 'finding' END AS reached FROM x""")
def finding_chain(spark, d):
    n = F.col("s_suppkey")
    found = _table(spark, d, "supplier").select(n.alias("finding_id"), F.when(n % 5 == 0, "csp").when(n % 5 == 1, "tls").when(n % 5 == 2, "ssh").when(n % 5 == 3, "none").alias("kind"))
    controls = spark.createDataFrame([("csp", "SI-10"), ("tls", "SC-8"), ("ssh", "AC-7")], "kind string, control_id string")
    id_ = lambda prefix: F.concat(F.lit(prefix), F.col("finding_id").cast("string"))
    risks = found.where("finding_id % 3 = 0").select("finding_id", id_("RISK-").alias("risk_id"))
    plans = found.where("finding_id % 6 = 0").select(id_("RISK-").alias("risk_id"), id_("AP-").alias("plan_id"))
    return assurance.finding_chain(found, controls, risks, plans).select("finding_id", "kind", "control_id", "risk_id", "plan_id", "reached")


@_query(S.query(S.GROUPS + """,
intel AS (SELECT '192.0.2.' || s_suppkey AS asset_id, s_suppkey % 2 = 0 AS known_exploited, s_suppkey % 10 / 10 AS likelihood, s_suppkey % 3 = 0 AS old FROM (SELECT s_suppkey % 250 AS s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 250 ORDER BY supplier.s_suppkey DESC) AS place FROM supplier) WHERE place = 1)""", """
SELECT group_id, risk_score, CASE WHEN likelihood IS NULL THEN 'missing' WHEN old THEN 'stale' ELSE 'used' END AS intel_state,
  least(100, risk_score + CASE WHEN old OR old IS NULL THEN 0 ELSE CASE WHEN known_exploited THEN 15 ELSE 0 END + CAST(round(likelihood * 10) AS INTEGER) END) AS intel_score, CASE WHEN NOT old THEN 'feed/' || asset_id END AS source_ref
FROM groups LEFT JOIN intel USING (asset_id)"""))
def intelligence_score(spark, d):
    """Intelligence on addresses from all suppliers, the last one of each address, every third of it stale; the other assets have none."""
    n = F.col("n")
    asset = F.concat(F.lit("192.0.2."), n.cast("string"))
    last = _table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 250).alias("n")).agg(F.max("s_suppkey").alias("s_suppkey"))
    intel = last.select(asset.alias("asset_id"), (n % 2 == 0).alias("known_exploited"), (n % 10 / 10).alias("likelihood"), F.when(n % 3 == 0, "2025-01-01").otherwise("2026-07-01").cast("date").alias("retrieved_on"), F.lit(30).alias("ttl_days"), F.concat(F.lit("feed/"), asset).alias("source_ref"))
    return assurance.with_intelligence(_flow(spark, d).alert_groups, intel, "2026-07-06").select("group_id", "risk_score", "intel_state", "intel_score", "source_ref")


@_query("""
SELECT p_partkey, 'step ' || p_name AS attack_step, CASE WHEN p_partkey % 3 > 0 THEN 'see ' || p_type END AS detection_opportunity, 'AC-' || p_size AS affected_control, CASE WHEN p_partkey % 5 > 0 THEN 'risk of ' || p_brand END AS risk_statement, 'check ' || p_partkey AS validation_check,
  CASE WHEN p_partkey % 7 > 0 THEN 'replace it' END AS remediation_guidance, p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS complete, true AS lab_only, false AS production_validated FROM part""")
def knowledge_fields(spark, d):
    n = F.col("p_partkey")
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\n"))
    text = F.concat(
        F.lit("A writeup\n"), line("Attack Step", F.concat(F.lit("step "), "p_name")), F.when(n % 3 > 0, line("  detection opportunity ", F.concat(F.lit("see "), "p_type"))).otherwise("no detection opportunity: none\n"), line("Affected control", F.concat(F.lit("AC-"), F.col("p_size").cast("string"))),
        F.when(n % 5 > 0, line("RISK STATEMENT", F.concat(F.lit("risk of "), "p_brand"))).otherwise("Risk statement:\n"), line("Validation check", F.concat(F.lit("check "), n.cast("string"))), F.when(n % 7 > 0, "Remediation guidance: replace it").otherwise(""))
    return assurance.knowledge(_table(spark, d, "part").select("p_partkey", text.alias("text"))).drop("text")


@_query("""
WITH c AS (SELECT o_orderkey AS candidate_id, o_custkey AS content_key, o_orderkey % 11 > 0 AS source_ok, CASE WHEN o_orderkey % 13 > 0 THEN true END AS schema_ok, o_orderkey % 100 / 100 AS confidence, o_orderkey % 3 = 0 AS lab_only, CASE o_orderkey % 8 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END AS decision, CAST(o_orderdate AS DATE) AS expires_on FROM orders),
r AS (SELECT candidate_id, CASE WHEN NOT source_ok THEN 'source' WHEN schema_ok IS NULL THEN 'schema' WHEN candidate_id <> min(candidate_id) OVER (PARTITION BY content_key) THEN 'duplicate' WHEN expires_on < DATE '1995-01-01' THEN 'expired' WHEN decision = 'rejected' THEN 'reviewer' WHEN decision = 'approved' THEN 'approved' WHEN lab_only THEN 'lab_only' WHEN confidence < 0.8 THEN 'confidence' ELSE 'confident' END AS reason FROM c)
SELECT reason, CASE WHEN reason IN ('approved', 'confident') THEN 'active' WHEN reason = 'expired' THEN 'expired' WHEN reason IN ('lab_only', 'confidence') THEN 'review' ELSE 'rejected' END AS state, count(*) AS n, min(candidate_id) AS first_id FROM r GROUP BY ALL""")
def knowledge_promotion(spark, d):
    n = F.col("o_orderkey")
    candidates = _table(spark, d, "orders").select(n.alias("candidate_id"), F.col("o_custkey").alias("content_key"), (n % 11 > 0).alias("source_ok"), F.when(n % 13 > 0, True).alias("schema_ok"), (n % 100 / 100).alias("confidence"), (n % 3 == 0).alias("lab_only"), F.when(n % 8 == 0, "approved").when(n % 8 == 1, "rejected").alias("decision"), F.col("o_orderdate").cast("date").alias("expires_on"))
    return assurance.promoted(candidates, "1995-01-01").groupBy("reason", "state").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_id"))


@_query("""
WITH v AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'target_not_allowed' WHEN o_orderkey % 11 = 0 THEN 'outside_scope' WHEN o_orderkey % 13 = 0 THEN 'outside_window' WHEN o_orderkey % 4 > 2 THEN 'level_too_high' WHEN o_orderkey % 5 = 0 THEN 'no_rate_limit' WHEN o_orderkey % 9 = 0 THEN 'unknown_tool' WHEN o_orderkey % 6 = 1 THEN 'policy' ELSE 'ok' END AS verdict FROM orders)
SELECT verdict, count(*) AS n FROM v GROUP BY verdict""")
def check_safety(spark, d):
    n = F.col("o_orderkey")
    checks = _table(spark, d, "orders").select((n % 7 > 0).alias("in_allowlist"), F.when(n % 11 > 0, True).alias("in_scope"), (n % 13 > 0).alias("in_window"), (n % 4).alias("level"), F.lit(2).alias("safety_level"), F.when(n % 5 > 0, 2).alias("rate_limit"), (n % 9 > 0).alias("tool_registered"), F.when(n % 6 == 1, "deny").otherwise("allow").alias("policy_effect"))
    return assurance.check_verdicts(checks).groupBy("verdict").agg(F.count("*").alias("n"))


@_query("""
WITH q AS (SELECT o_orderkey AS job_id, unnest(generate_series(1, CAST(1 + o_orderkey % 4 AS BIGINT))) AS place FROM orders),
l AS (SELECT l_orderkey AS job_id, l_linenumber AS place, CASE max(l_returnflag) WHEN 'A' THEN 'running' WHEN 'N' THEN 'done' WHEN 'R' THEN CASE WHEN l_orderkey % 5 = 0 THEN 'failed' ELSE 'done' END END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT job_id, coalesce(status, 'queued') AS status FROM q LEFT JOIN l USING (job_id, place)),
c AS (SELECT job_id, count(*) AS checks, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed FROM s GROUP BY job_id)
SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN done = checks THEN 'done' WHEN queued = checks THEN 'queued' ELSE 'running' END AS state FROM c""")
def check_schedule(spark, d):
    """Jobs of one to four checks made of orders; their lines are the changes of status, after each of which comes a later one."""
    n = F.col("o_orderkey")
    names = F.transform(F.sequence(F.lit(1).cast("long"), 1 + n % 4), lambda i: F.concat(F.lit("check-"), i.cast("string")))
    queue = assurance.scheduled(_table(spark, d, "orders").select(n.alias("job_id"), names.alias("checks")))
    lines = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    status = F.when(F.col("flag") == "A", "running").when((F.col("flag") == "R") & (F.col("l_orderkey") % 5 == 0), "failed").otherwise("done")
    changes = lines.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("check_id"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("running").alias("status")), F.struct(F.lit(2).alias("seq"), status.alias("status")))).alias("c")).select("check_id", "c.*")
    return assurance.job_states(queue, changes)


_PACKED = """,
lines AS (SELECT DISTINCT incident_id, evidence_no, printf('EVID-%04d', evidence_no) AS evidence_id, 'sha256:' || sha256(data) AS content_hash FROM alerts JOIN incidents USING (dedup_key) JOIN evidence e ON printf('EVID-%04d', e.evidence_no) = alerts.evidence_id),
h1 AS (SELECT incident_id, evidence_no // 1000 AS block, 'sha256:' || sha256(string_agg(evidence_id || '=' || content_hash, ',' ORDER BY evidence_id)) AS h, count(*) AS n FROM lines GROUP BY ALL),
h2 AS (SELECT incident_id, block // 1000 AS part, 'sha256:' || sha256(string_agg(h, ',' ORDER BY block)) AS h, sum(n) AS n FROM h1 GROUP BY incident_id, block // 1000),
e AS (SELECT incident_id, 'sha256:' || sha256(string_agg(h, ',' ORDER BY part)) AS evidence_digest, CAST(sum(n) AS BIGINT) AS n_evidence FROM h2 GROUP BY incident_id),
x AS (SELECT i.incident_id, i.title, i.severity, m.control_id, printf('RISK-%04d', i.incident_no) AS risk_id, p.action_plan_id, e.evidence_digest, e.n_evidence FROM incidents i LEFT JOIN mappings m USING (incident_id) LEFT JOIN plans p USING (incident_id) LEFT JOIN e USING (incident_id))"""
_PACKAGE = "SELECT incident_id, control_id, risk_id, action_plan_id, n_evidence, 'sha256:' || sha256(incident_id || '|' || title || '|' || severity || '|' || coalesce(control_id, '-') || '|' || risk_id || '|' || coalesce(action_plan_id, '-') || '|' || evidence_digest) AS package_hash, true AS intact FROM x"


def _packed(spark, f) -> DataFrame:
    """Written as JSON to a new folder, read back, and checked against the evidence that was written with it."""
    lines = assurance.evidence_lines(f.incident_evidence, f.evidence)
    package = assurance.evidence_package(f.incidents, f.control_mappings, f.risks, f.action_plans, lines)
    path = fresh_path(spark, "package")
    assurance.write_package(package, lines, path)
    again = assurance.checked_package(spark.read.schema(package.schema).json(f"{path}/incidents"), spark.read.schema(lines.schema).json(f"{path}/evidence"))
    return again.select("incident_id", "control_id", "risk_id", "action_plan_id", "n_evidence", "package_hash", "intact")


@_query(S.query(S.PLANS + _PACKED, _PACKAGE))
def evidence_package(spark, d):
    return _packed(spark, _flow(spark, d))


def _one_address(spark, d):
    error, n = F.col("event_type") == "error", F.col("event_id")
    events = _table(spark, d, "events").withColumns({"user_id": F.when(error, F.lit(7).cast("long")).otherwise(F.col("user_id")), "event_id": n * 6 + F.when(error, 1).otherwise(n % 6)})
    return run_flow(raw.event_sources(events, 30))


_HOT = S.PLANS.replace("event_id // 1000 AS file_no", "event_id // 30 AS file_no").replace("FROM events)", "FROM (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN 7 ELSE user_id END AS user_id, event_id * 6 + CASE WHEN event_type = 'error' THEN 1 ELSE event_id % 6 END AS event_id) FROM events))")


@_query(S.query(_HOT + _PACKED, _PACKAGE))
def hot_group_package(spark, d):
    """The same where one address fails to log in to one host in all error events, over files of five events: a group with more evidence than any list holds."""
    return _packed(spark, _one_address(spark, d))


@_query(S.query(_HOT, "SELECT group_id, count, len(string_split(evidence_ids, ',')) AS evidence_count, risk_score, disposition FROM triaged"))
def hot_group_counts(spark, d):
    return _one_address(spark, d).triaged.select("group_id", "count", "evidence_count", "risk_score", "disposition")


@_query("""
WITH u AS (SELECT p_partkey, p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.exe' WHEN 2 THEN '.pdf' WHEN 3 THEN '.md' ELSE '' END AS name, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE repeat(p_name, 1 + p_partkey % 3) END AS data FROM part),
m AS (SELECT *, CASE WHEN ends_with(lower(name), '.txt') THEN 'text/plain' WHEN ends_with(lower(name), '.md') THEN 'text/markdown' WHEN ends_with(lower(name), '.pdf') THEN 'application/pdf' END AS media_type FROM u)
SELECT name, media_type, octet_length(encode(data)) AS size_bytes, 'sha256:' || sha256(data) AS content_hash, CASE WHEN media_type IS NULL THEN 'media_type' WHEN data = '' THEN 'empty' WHEN octet_length(encode(data)) > 60 THEN 'too_large' END AS refused FROM m""")
def upload_screening(spark, d):
    n = F.col("p_partkey")
    name = F.concat(n.cast("string"), F.when(n % 5 == 0, ".TXT").when(n % 5 == 1, ".exe").when(n % 5 == 2, ".pdf").when(n % 5 == 3, ".md").otherwise(""))
    data = F.when(n % 8 == 0, "").otherwise(F.repeat("p_name", (1 + n % 3).cast("int")))
    return assurance.uploads(_table(spark, d, "part").select(name.alias("name"), F.encode(data, "UTF-8").alias("data")), 60)


#: Raw sources to a file that is written: files stay small enough to be read whole, however few tasks write them.
SOURCES_PER_FILE = 20


@_query(S.query(S.ALERTS, "SELECT source, count(*) AS alerts, count(DISTINCT dedup_key) AS keys FROM alerts GROUP BY source"))
def source_files(spark, d):
    """The raw sources written as files and read as whole files, a type's folder at a time."""
    sources, read = raw.event_sources(_table(spark, d, "events")), None
    for kind, media in (("linux_auth", "text/plain"), ("suricata_eve", "application/x-ndjson")):
        path = fresh_path(spark, kind)
        sources.where(F.col("source_type") == kind).select(F.decode("data", "UTF-8").alias("value")).write.option("maxRecordsPerFile", SOURCES_PER_FILE).text(path)
        own = raw.read_sources(spark, path, kind, media).select("*", F.lit(raw.ORDER[kind]).alias("source_ord"))
        read = own if read is None else read.unionByName(own)
    # the files of a folder are named part-00000 and so on: those of ten tasks are numbered at a time, without their data
    names = numbered(read.select("source_ord", "name"), ["source_ord", "name"], F.concat_ws("/", "source_ord", F.left(F.substring_index("name", "/", -1), F.lit(9))), "file_no")
    named = read.join(save(names, "names"), ["source_ord", "name"])
    return normalize.parse(raw.source_lines(raw.with_evidence(named, "2026-07-06T21:15:00Z"))).groupBy("source").agg(F.count("*").alias("alerts"), F.countDistinct("dedup_key").alias("keys"))


def _files(spark, d) -> DataFrame:
    """The notes as text files below a folder, those of every fourth part under a prefix that is skipped, and a binary one."""
    from vigilake.plans import catalogue

    path = fresh_path(spark, "tracked")
    n = F.substring_index("location", "-", -1).cast("long")
    notes = catalogue._notes(spark, d)
    notes.where(n % 4 != 0).select(F.col("text").alias("value")).write.option("maxRecordsPerFile", 5000).text(f"{path}/src")
    notes.where(n % 4 == 0).select(F.col("text").alias("value")).write.option("maxRecordsPerFile", 5000).text(f"{path}/uploads/x")
    notes.where(n % 4 == 1).select(F.concat(F.lit("\0"), "text").alias("value")).write.option("maxRecordsPerFile", 5000).text(f"{path}/bin")
    return raw.scannable_files(spark, path)


def file_scan_counts(spark, d):
    """The tracked files' findings by severity and rule."""
    return scan.findings(_files(spark, d)).groupBy("severity", "rule").agg(F.count("*").alias("n"))


def file_scan_report(spark, d):
    """The report as it is written, read back in the order of its files and lines: that order itself, and whether a check of each strictness fails."""
    found = scan.findings(_files(spark, d))
    path = fresh_path(spark, "report")
    scan.write_report(found, path)
    again = scan.read_report(spark, path, scan.report(found).schema)
    per = again.groupBy("severity").agg(F.count("*").alias("findings"), F.min("position").alias("first_place"), F.max("position").alias("last_place"), F.count_if(~F.col("in_order")).alias("out_of_order"))
    fails = scan.threshold(again).groupBy().pivot("fail_on", ["high", "medium", "never"]).agg(F.first("failed"))
    return per.join(fails.select(*(F.col(c).alias(f"fails_{c}") for c in ("high", "medium", "never"))), how="cross")  # one row


def history_scan(spark, d):
    """Histories of texts by brand and by source: findings of all that are not too large, and a row for each that is."""
    from vigilake.plans import catalogue

    docs = _table(spark, d, "documents").select(F.col("source").alias("history"), F.col("doc_id").alias("seq"), "text")
    number = F.substring_index("location", "-", -1).cast("long")
    brands = catalogue._notes(spark, d).select(number.alias("p_partkey"), "text").join(_table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    # one brand's history is as long as no other: each of its texts stands behind a megabyte of blanks
    long = F.when(F.col("p_brand") == "Brand#11", F.concat(F.repeat(F.lit(" "), F.lit(1_000_000)), F.lit("\n"), "text")).otherwise(F.col("text"))
    found = scan.history_findings(docs.unionByName(brands.select(F.col("p_brand").alias("history"), F.col("p_partkey").alias("seq"), long.alias("text"))))
    return found.groupBy("severity", "rule", "location").agg(F.count("*").alias("n"))


@_query("SELECT 'N-' || n_nationkey AS obj_id, n_name AS name FROM nation WHERE n_nationkey = 7")
def collection_lookup(spark, d):
    rows = _table(spark, d, "nation").select(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("obj_id"), F.col("n_name").alias("name"))
    return collections_.get(rows, "obj_id", "N-7")


@_query("""
WITH w AS (SELECT 'C-' || o_custkey AS obj_id, min(o_orderkey) AS first_seq, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)
SELECT obj_id, status, row_number() OVER (ORDER BY obj_id) AS by_id, row_number() OVER (ORDER BY first_seq) AS by_insertion FROM w""")
def collection_listing(spark, d):
    """A collection's places in order of the ids' text and of insertion; a row that is saved again keeps its place."""
    writes = _table(spark, d, "orders").select(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("obj_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    rows = collections_.last_written(writes, "obj_id", "seq").select("obj_id", "status", "first_seq")
    by_id = numbered(rows, ["obj_id"], F.rpad(F.substring("obj_id", 3, 3), 3, " "), "by_id")
    return numbered(by_id, ["first_seq"], F.floor(F.col("first_seq") / BUCKET), "by_insertion").select("obj_id", "status", "by_id", "by_insertion")


@_query("""
WITH p AS (SELECT p_partkey, 'CWE-' || (p_partkey % 6) AS weakness FROM part), c(weakness, control_id) AS (VALUES ('CWE-0', 'AC-7'), ('CWE-0', 'IA-2'), ('CWE-1', 'SC-8'), ('CWE-4', 'SI-10'))
SELECT p_partkey, weakness, control_id FROM p LEFT JOIN c USING (weakness)""")
def vulnerability_controls(spark, d):
    controls = spark.createDataFrame([("CWE-0", "AC-7"), ("CWE-0", "IA-2"), ("CWE-1", "SC-8"), ("CWE-4", "SI-10")], "weakness string, control_id string")
    findings = _table(spark, d, "part").select("p_partkey", F.concat(F.lit("CWE-"), (F.col("p_partkey") % 6).cast("string")).alias("weakness"))
    return assurance.vulnerability_controls(findings, controls).select("p_partkey", "weakness", "control_id")


@_query("""
WITH w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'grc.map' ELSE 'soc.triage' END AS name, CASE s_suppkey % 4 WHEN 0 THEN '0.2.0' WHEN 1 THEN '9' END AS version FROM supplier)
SELECT *, CASE WHEN name <> 'soc.triage' THEN 'unknown' WHEN version <> '0.2.0' THEN 'other_version' ELSE 'ok' END AS outcome, CASE WHEN name = 'soc.triage' THEN '0.2.0' END AS registered FROM w""")
def agent_resolution(spark, d):
    n = F.col("s_suppkey")
    wanted = _table(spark, d, "supplier").select(n, F.when(n % 3 == 0, "grc.map").otherwise("soc.triage").alias("name"), F.when(n % 4 == 0, "0.2.0").when(n % 4 == 1, "9").alias("version"))
    return triage.resolutions(wanted)


@_query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS first FROM events WHERE event_type = 'error'),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT 'u' || user_id AS dedup_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS alerts FROM s GROUP BY user_id, n""")
def alert_sessions(spark, d):
    """Bursts of a user's error events with gaps of at most half an hour."""
    events = _table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dedup_key"), F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy(F.session_window("ts", "30 minutes 1 microsecond").alias("w"), "dedup_key").agg(F.count("*").alias("alerts"))
    return found.select("dedup_key", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "alerts")


QUERIES |= {f.__name__: f for f in (file_scan_counts, file_scan_report, history_scan)}


def twins(scan_sql) -> dict[str, str]:
    """All SQL twins; scan_sql(select): findings of the notes and documents as `found`."""
    found = scan_sql("SELECT severity, rule, count(*) AS n FROM found WHERE starts_with(location, 'part-') AND CAST(split_part(location, '-', 2) AS BIGINT) % 4 > 0 GROUP BY severity, rule")
    report = scan_sql("""
, mine AS (SELECT severity FROM found WHERE starts_with(location, 'part-') AND CAST(split_part(location, '-', 2) AS BIGINT) % 4 > 0),
c AS (SELECT severity, count(*) AS findings, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS place FROM mine GROUP BY severity),
p AS (SELECT *, CAST(sum(findings) OVER (ORDER BY place) AS BIGINT) AS last_place FROM c)
SELECT severity, findings, last_place - findings + 1 AS first_place, last_place, CAST(0 AS BIGINT) AS out_of_order, (SELECT bool_or(severity = 'HIGH') FROM c) AS fails_high, (SELECT bool_or(severity <> 'INFO') FROM c) AS fails_medium, false AS fails_never FROM p""")
    history = scan_sql("""
, sized AS (
  SELECT source AS history, sum(octet_length(encode(text))) > 25000000 AS large FROM documents GROUP BY source
  UNION ALL SELECT p_brand, sum(octet_length(encode(text)) + CASE WHEN p_brand = 'Brand#11' THEN 1000001 ELSE 0 END) > 25000000 FROM notes JOIN part ON location = 'part-' || p_partkey GROUP BY p_brand),
placed AS (
  SELECT f.severity, f.rule, d.source AS history FROM found f JOIN documents d ON f.location = 'doc-' || d.doc_id
  UNION ALL SELECT f.severity, f.rule, p_brand FROM found f JOIN part ON f.location = 'part-' || p_partkey)
SELECT severity, rule, 'history:' || history AS location, count(*) AS n FROM placed JOIN sized USING (history) WHERE NOT large GROUP BY ALL UNION ALL SELECT 'INFO', 'history-scan-skipped', 'history:' || history, 1 FROM sized WHERE large""")
    return ORACLE_SQL | {"file_scan_counts": found, "file_scan_report": report, "history_scan": history}
