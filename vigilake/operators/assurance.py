"""Design-level assurance: metrics against expected results, safety thresholds, agent conflicts, the finding chain, knowledge, checks, exports.

As in `design`, these operations are only described where the others come from; their semantics are fixed here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import checked, content_hash

# fixed values: limits of the design
STOP_RATE, LOW_CONFIDENCE = 0.02, 0.5
URGENT = ("P0", "P1")


def _share(part: Column, whole: Column) -> Column:
    """A rate to six places; null where nothing is counted."""
    return F.round(F.try_divide(part, whole), 6)


def _rows(counted: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The values of a single row as rows (metric, value)."""
    each = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()]
    return counted.select(F.explode(F.array(*each)).alias("m")).select("m.metric", "m.value")


def soc_metrics(judged: DataFrame) -> DataFrame:
    """(metric, value) over groups (expected, predicted: dispositions; expected_priority, priority; alerts).

    Suppressions are false where something else was expected; an escalation is missed where another disposition was given.
    """
    e, p = F.col("expected"), F.col("predicted")
    due, given = F.col("expected_priority").isin(*URGENT), F.col("priority").isin(*URGENT)
    count = lambda name, x: F.count_if(x).alias(name)
    c = judged.agg(
        F.count("*").alias("groups"), F.sum("alerts").alias("alerts"), count("right", e == p), count("suppressed", p == "suppress"), count("wrongly", (p == "suppress") & (e != "suppress")), count("due", e == "escalate"), count("missed", (e == "escalate") & (p != "escalate")), count("incidents", p == "escalate"),
        count("urgent_due", due), count("urgent_given", given), count("urgent_both", due & given))
    f = F.col
    return _rows(c, {
        "triage_accuracy": _share(f("right"), f("groups")), "false_suppression_rate": _share(f("wrongly"), f("suppressed")), "missed_escalation_rate": _share(f("missed"), f("due")), "urgent_precision": _share(f("urgent_both"), f("urgent_given")), "urgent_recall": _share(f("urgent_both"), f("urgent_due")),
        "duplicate_reduction": F.round(1 - F.try_divide(f("groups"), f("alerts")), 6), "alerts_per_incident": _share(f("alerts"), f("incidents"))})


def ai_metrics(results: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(metric, value) over results (evidence_count, confidence, disposition, confirmed), what they claim (evidence_id, a row for each) and the evidence (evidence_id) that exists."""
    c = results.agg(F.count("*").alias("n"), F.count_if(F.col("evidence_count") > 0).alias("grounded"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low"), F.count_if(F.col("disposition") == "escalate").alias("escalated"), F.count_if((F.col("disposition") == "escalate") & ~F.col("confirmed")).alias("refused"))
    claims = claims.groupBy("evidence_id").agg(F.count("*").alias("n"))
    known = evidence.select("evidence_id").distinct().withColumn("known", F.lit(True))
    claimed = claims.join(known, "evidence_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("invented"))
    f = F.col
    return _rows(c.crossJoin(claimed), {"evidence_grounding_rate": _share(f("grounded"), f("n")), "hallucinated_claim_rate": _share(f("invented"), f("claims")), "low_confidence_rate": _share(f("low"), f("n")), "skeptic_disagreement_rate": _share(f("refused"), f("escalated"))})  # both have one row


def grc_metrics(mappings: DataFrame, risks: DataFrame) -> DataFrame:
    """(metric, value) over mappings (control_id, expected_control, evidence_count) and risks (statement, asset_id)."""
    m = mappings.agg(F.count("*").alias("n"), F.count_if(F.col("control_id") == F.col("expected_control")).alias("right"), F.count_if(F.col("evidence_count") > 0).alias("backed"))
    named = F.contains("statement", "asset_id") & ~F.contains("statement", F.lit("n/a"))
    r = risks.agg(F.count("*").alias("risks"), F.count_if(F.coalesce(named, F.lit(False))).alias("whole"))
    f = F.col
    return _rows(m.crossJoin(r), {"control_mapping_accuracy": _share(f("right"), f("n")), "evidence_sufficiency": _share(f("backed"), f("n")), "risk_statement_quality": _share(f("whole"), f("risks"))})  # both have one row


def remediation_metrics(executions: DataFrame) -> DataFrame:
    """(metric, value) over executions (preflight_ok, executed, failed, verified, rollback_ok; rollback_ok null: none was made)."""
    c = executions.agg(F.count("*").alias("n"), *(F.count_if(F.col(x)).alias(x) for x in ("preflight_ok", "executed", "failed", "verified", "rollback_ok")), F.count("rollback_ok").alias("rollbacks"))
    c = c.select("n", "preflight_ok", F.col("executed").alias("ran"), F.col("failed").alias("broke"), F.col("verified").alias("passed"), "rollback_ok", "rollbacks")
    f = F.col
    return _rows(c, {"preflight_success_rate": _share(f("preflight_ok"), f("n")), "verification_pass_rate": _share(f("passed"), f("ran")), "rollback_success_rate": _share(f("rollback_ok"), f("rollbacks")), "failed_execution_rate": _share(f("broke"), f("ran"))})


def error_stops(requests: DataFrame, most: float = STOP_RATE) -> DataFrame:
    """Each target of requests (target, error) with its error rate, and whether it stops the job: above the threshold, or unknown."""
    c = requests.groupBy("target").agg(F.count("*").alias("requests"), F.count_if(F.col("error")).alias("errors"), F.count_if(F.col("error").isNull()).alias("unknown"))
    return c.select("target", "requests", "errors", _share(F.col("errors"), F.col("requests")).alias("rate"), ((F.col("errors") > most * F.col("requests")) | (F.col("unknown") > 0)).alias("stop"))


def safety_checks(judged: DataFrame, confirmed: DataFrame, rules: DataFrame, plans: DataFrame) -> DataFrame:
    """(name, violations, passed) of the thresholds that nothing may break.

    judged: expected_priority, predicted, evidence_count; confirmed: predicted of groups that became confirmed incidents; rules: expiry; plans: rollback.
    """
    def check(df: DataFrame, name: str, broken: Column) -> DataFrame:
        return df.agg(F.count_if(F.coalesce(broken, F.lit(True))).alias("violations")).select(F.lit(name).alias("name"), "violations", (F.col("violations") == 0).alias("passed"))

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return reduce(DataFrame.unionByName, [
        check(judged, "no urgent alert is suppressed", F.col("expected_priority").isin(*URGENT) & (F.col("predicted") == "suppress")), check(confirmed, "no confirmed incident is missed", F.col("predicted") != "escalate"), check(judged, "triage refers to evidence", F.col("evidence_count") <= 0),
        check(rules, "suppression rules expire", blank("expiry")), check(plans, "plans can be rolled back", blank("rollback")),
    ])


def agent_conflicts(results: DataFrame, claims: DataFrame) -> DataFrame:
    """Tasks on which agents disagree: results (task, agent, disposition, confidence; a few agents to a task), claims (task, agent, evidence_id).

    The originals stay as they are, in order of agent; common and disputed count the evidence that all share and the rest (`disputes`
    names it). Resolved by rule only if all results that have evidence and are not of low confidence agree; else a human reviews.
    """
    has = claims.select("task", "agent").distinct().withColumn("grounded", F.lit(True))
    sound = F.coalesce("grounded", F.lit(False)) & (F.col("confidence") >= LOW_CONFIDENCE)
    c = results.join(has, ["task", "agent"], "left").groupBy("task").agg(
        F.countDistinct("disposition").alias("views"), F.array_sort(F.collect_list(F.struct("agent", "disposition", "confidence"))).alias("results"), F.count_if(F.col("grounded").isNull()).alias("without_evidence"),
        F.countDistinct(F.when(sound, F.col("disposition"))).alias("sound_views"), F.min(F.when(sound, F.col("disposition"))).alias("sound_view"))
    by_rule = F.col("sound_views") == 1
    c = c.where("views > 1").select("task", "results", "without_evidence", F.when(by_rule, F.col("sound_view")).otherwise("review").alias("decision"), F.when(by_rule, "sound-results-agree/1").otherwise("human").alias("resolver"))
    counts = disputes(results, claims).groupBy("task").agg(F.count_if("common").alias("common_evidence"), F.count_if(~F.col("common")).alias("disputed_evidence"))
    return c.join(counts, "task", "left").na.fill(0, ["common_evidence", "disputed_evidence"])


def disputes(results: DataFrame, claims: DataFrame) -> DataFrame:
    """(task, evidence_id, agents, common) of tasks on which agents disagree: how many of its agents claim the evidence, and whether all do."""
    split = results.groupBy("task").agg(F.countDistinct("disposition").alias("views"), F.countDistinct("agent").alias("all")).where("views > 1").select("task", "all")
    each = claims.groupBy("task", "evidence_id").agg(F.countDistinct("agent").cast("int").alias("agents"))
    return each.join(split, "task").select("task", "evidence_id", "agents", (F.col("agents") == F.col("all")).alias("common"))


def dispute_lists(results: DataFrame, claims: DataFrame) -> DataFrame:
    """(task, common_evidence, disputed_evidence) of tasks on which agents disagree: the evidence of `disputes` by name, in order, whole."""
    names = lambda of: F.array_sort(F.collect_list(F.when(of, F.col("evidence_id"))))
    return disputes(results, claims).groupBy("task").agg(names(F.col("common")).alias("common_evidence"), names(~F.col("common")).alias("disputed_evidence"))


def finding_chain(findings: DataFrame, controls: DataFrame, risks: DataFrame, plans: DataFrame) -> DataFrame:
    """findings (finding_id, kind) with what came of them: control_id (by kind), risk_id (by finding_id), plan_id (by risk_id), each null if none, and the last link that is there."""
    out = findings.join(controls.select("kind", "control_id"), "kind", "left").join(risks.select("finding_id", "risk_id"), "finding_id", "left").join(plans.select("risk_id", "plan_id"), "risk_id", "left")
    reached = F.when(F.col("plan_id").isNotNull(), "plan").when(F.col("risk_id").isNotNull(), "risk").when(F.col("control_id").isNotNull(), "control").otherwise("finding")
    return out.withColumn("reached", reached)


def vulnerability_controls(findings: DataFrame, controls: DataFrame) -> DataFrame:
    """findings (cve, weakness) with the controls that answer their weakness (controls: weakness, control_id), one row for each; null where none is known."""
    return findings.join(checked(controls.select("weakness", "control_id").distinct()), "weakness", "left")


# fixed values: weight of outside intelligence in a score
EXPLOITED_BONUS, LIKELIHOOD_BONUS = 15, 10


def with_intelligence(scored: DataFrame, intelligence: DataFrame, as_of: str) -> DataFrame:
    """scored (asset_id, risk_score, ...) with intel_score and intel_state: intelligence (asset_id, known_exploited, likelihood, retrieved_on, ttl_days, source_ref), one row per asset.

    What is missing or stale adds nothing and is named as such, and so never raises confidence; the source is kept where it counted.
    """
    joined = scored.join(intelligence, "asset_id", "left")
    state = F.when(F.col("retrieved_on").isNull(), "missing").when(F.date_add("retrieved_on", F.coalesce("ttl_days", F.lit(0))) < F.lit(as_of).cast("date"), "stale").otherwise("used")
    bonus = F.when(F.coalesce("known_exploited", F.lit(False)), EXPLOITED_BONUS).otherwise(0) + F.round(F.coalesce("likelihood", F.lit(0.0)) * LIKELIHOOD_BONUS).cast("int")
    out = joined.withColumn("intel_state", state).withColumn("intel_score", F.least(F.lit(100), F.col("risk_score") + F.when(F.col("intel_state") == "used", bonus).otherwise(0)).cast("int"))
    return out.withColumn("source_ref", F.when(F.col("intel_state") == "used", F.col("source_ref"))).drop("known_exploited", "likelihood", "retrieved_on", "ttl_days")


# fixed values: the fields of a knowledge record
KNOWLEDGE_FIELDS = ("attack_step", "detection_opportunity", "affected_control", "risk_statement", "validation_check", "remediation_guidance")


def knowledge(docs: DataFrame) -> DataFrame:
    """docs (text) with the fields that stand on lines of their own as `Attack step: ...` (null: none), complete, and the defaults of records from a lab."""
    field = lambda name: F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), rf"(?im)^[ \t]*{name.replace('_', ' ')}[ \t]*:(.*)$", 1)), F.lit(""))
    out = docs.withColumns({name: field(name) for name in KNOWLEDGE_FIELDS})
    whole = reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in KNOWLEDGE_FIELDS))
    return out.withColumns({"complete": whole, "lab_only": F.lit(True), "production_validated": F.lit(False)})


def promoted(candidates: DataFrame, as_of: str, least: float = 0.8) -> DataFrame:
    """candidates with state and reason: active, review, rejected or expired.

    candidates: candidate_id, content_key, source_ok, schema_ok, confidence, lab_only, decision (approved, rejected or null), expires_on.
    Of equal content the first candidate counts. Null is never a pass; what comes from a lab needs an approval.
    """
    first = candidates.groupBy("content_key").agg(F.min("candidate_id").alias("__first"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(no("source_ok"), "source").when(no("schema_ok"), "schema").when(F.col("candidate_id") != F.col("__first"), "duplicate").when(F.col("expires_on") < F.lit(as_of).cast("date"), "expired").when(F.col("decision") == "rejected", "reviewer")
        .when(F.col("decision") == "approved", "approved").when(F.coalesce("lab_only", F.lit(True)), "lab_only").when(F.coalesce(F.col("confidence") < least, F.lit(True)), "confidence").otherwise("confident")
    )
    state = F.when(F.col("reason").isin("approved", "confident"), "active").when(F.col("reason") == "expired", "expired").when(F.col("reason").isin("lab_only", "confidence"), "review").otherwise("rejected")
    return candidates.join(first, "content_key", "left").withColumn("reason", reason).withColumn("state", state).drop("__first")


def check_verdicts(checks: DataFrame) -> DataFrame:
    """checks with verdict: the first rule that is not known to hold, or ok.

    checks: in_allowlist, in_scope, in_window (booleans), level and safety_level (integers), rate_limit, tool_registered, policy_effect.
    """
    no = lambda x: ~F.coalesce(x, F.lit(False))
    f = F.col
    return checks.withColumn("verdict", F.when(no(f("in_allowlist")), "target_not_allowed").when(no(f("in_scope")), "outside_scope").when(no(f("in_window")), "outside_window").when(no(f("level") <= f("safety_level")), "level_too_high").when(no(f("rate_limit") > 0), "no_rate_limit").when(no(f("tool_registered")), "unknown_tool").when(no(f("policy_effect") == "allow"), "policy").otherwise("ok"))


def scheduled(jobs: DataFrame) -> DataFrame:
    """The queue of jobs (job_id, checks array<string>): a row per check in order, with a check_id."""
    return jobs.select("job_id", F.posexplode("checks").alias("place", "check")).withColumn("check_id", F.concat_ws("/", F.col("job_id").cast("string"), (F.col("place") + 1).cast("string")))


def job_states(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """Each job's checks by their last status (changes: check_id, seq, status; none: queued) and the job's state."""
    last = changes.groupBy("check_id").agg(F.max_by("status", "seq").alias("status"))
    at = queue.join(last, "check_id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))
    n = {s: F.count_if(F.col("status") == s) for s in ("queued", "running", "done", "failed")}
    c = at.groupBy("job_id").agg(F.count("*").alias("checks"), *(v.alias(k) for k, v in n.items()))
    return c.withColumn("state", F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("checks"), "done").when(F.col("queued") == F.col("checks"), "queued").otherwise("running"))


#: Evidence that is hashed as one list: so many numbers of evidence, and then so many of these hashes.
HASHED = 1000


def evidence_lines(incident_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every piece of evidence of every incident with its hash: (incident_id, evidence_no, evidence_id, content_hash); `missing` where it does not exist.

    evidence_no: the number that ends the id, null if none does.
    """
    of = incident_evidence.join(evidence.select("evidence_id", "content_hash"), "evidence_id", "left")
    return of.select("incident_id", F.expr("try_cast(substring_index(evidence_id, '-', -1) AS bigint)").alias("evidence_no"), "evidence_id", F.coalesce("content_hash", F.lit("missing")).alias("content_hash"))


def evidence_digests(lines: DataFrame) -> DataFrame:
    """(incident_id, n_evidence, evidence_digest): a hash over all of an incident's evidence, whatever its amount.

    Lines are hashed in order by the thousands of their numbers, these hashes by the millions, and so on three times: no list has
    more than HASHED rows up to a billion pieces of evidence.
    """
    def hashed(df: DataFrame, by: list[str], item, n) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col("at"), item.alias("x"))))
        return df.groupBy(*by).agg(content_hash(F.array_join(F.transform(rows, lambda r: r["x"]), ",")).alias("h"), n.alias("n"))

    at = lines.select("incident_id", "evidence_no", F.col("evidence_id").alias("at"), F.concat_ws("=", "evidence_id", "content_hash").alias("line"))
    out = hashed(at.withColumn("block", F.expr(f"evidence_no div {HASHED}")), ["incident_id", "block"], F.col("line"), F.count("*"))
    out = hashed(out.select("incident_id", F.expr(f"block div {HASHED}").alias("group"), F.col("block").alias("at"), "h", "n"), ["incident_id", "group"], F.col("h"), F.sum("n"))
    out = hashed(out.select("incident_id", F.col("group").alias("at"), "h", "n"), ["incident_id"], F.col("h"), F.sum("n"))
    return out.select("incident_id", F.col("n").alias("n_evidence"), F.col("h").alias("evidence_digest"))


def evidence_package(incidents: DataFrame, mappings: DataFrame, risks: DataFrame, plans: DataFrame, lines: DataFrame) -> DataFrame:
    """One audit-ready row per incident: what it was mapped to and planned, the digest of its evidence (lines, which go into the package as a table of their own), and the hash of all that."""
    out = incidents.select("incident_id", "title", "severity").join(mappings.select("incident_id", "control_id"), "incident_id", "left").join(risks.select(F.col("related_incident_id").alias("incident_id"), "risk_id"), "incident_id", "left")
    out = out.join(plans.select(F.col("created_from").alias("incident_id"), "action_plan_id"), "incident_id", "left").join(evidence_digests(lines), "incident_id", "left")
    parts = ["incident_id", "title", "severity", "control_id", "risk_id", "action_plan_id", "evidence_digest"]
    return out.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0).cast("long"))).withColumn("package_hash", content_hash(F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in parts))))


def write_package(package: DataFrame, lines: DataFrame, path: str) -> None:
    """The package as JSON lines in new folders: incidents, and their evidence."""
    package.write.json(f"{path}/incidents")
    lines.write.json(f"{path}/evidence")


def checked_package(package: DataFrame, lines: DataFrame) -> DataFrame:
    """package (as it was read back) with intact: its evidence is there as it was when it was packed."""
    again = evidence_digests(lines).select("incident_id", F.col("evidence_digest").alias("__d"))
    return package.join(again, "incident_id", "left").withColumn("intact", F.col("evidence_digest").eqNullSafe(F.col("__d"))).drop("__d")


# fixed values: what may be uploaded
MEDIA_TYPES = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "pdf": "application/pdf"}
MAX_UPLOAD_BYTES = 10_000_000


def uploads(files: DataFrame, most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """files (name, data) with media_type (null: not allowed), size_bytes, content_hash and the reason of refusal (null: accepted)."""
    media = F.lit(None).cast("string")
    for end, kind in MEDIA_TYPES.items():
        media = F.when(F.endswith(F.lower("name"), F.lit("." + end)), kind).otherwise(media)
    out = files.select("name", media.alias("media_type"), F.octet_length("data").cast("long").alias("size_bytes"), content_hash(F.col("data")).alias("content_hash"))
    return out.withColumn("refused", F.when(F.col("media_type").isNull(), "media_type").when(F.col("size_bytes").isNull() | (F.col("size_bytes") == 0), "empty").when(F.col("size_bytes") > most, "too_large"))
