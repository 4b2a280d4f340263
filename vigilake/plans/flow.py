"""The whole flow as one plan: raw sources to evidence, alerts, groups, triage, incidents, mappings, risks, plans and decisions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import number
from vigilake.operators import grc, grouping, normalize, policy, remediation, triage
from vigilake.sources import raw
from vigilake.sources.store import save

RUN_AT = "2026-07-06T21:15:00Z"
#: What a replay must reproduce.
COLLECTIONS = ("evidence", "alerts", "alert_groups", "group_evidence", "agent_runs", "incidents", "incident_evidence", "control_mappings", "risks", "action_plans", "policy_decisions")


class Flow:
    """The collections of a run, each made when it is first asked for.

    Those that others are made from are written once as tables, which cuts the lineage: numbering reads its input twice.
    """

    def __init__(self, sources: DataFrame, scope: DataFrame, actor: str, at: str):
        self.sources, self.scope, self.actor, self.at = sources, scope, actor, at

    @cached_property
    def evidence(self) -> DataFrame:
        return raw.with_evidence(raw.checked_sources(self.sources), self.at)

    @cached_property
    def alerts(self) -> DataFrame:
        return save(normalize.parse(raw.source_lines(self.evidence)), "alerts")

    @cached_property
    def alert_groups(self) -> DataFrame:
        return save(grouping.group(self.alerts), "groups")

    @cached_property
    def group_evidence(self) -> DataFrame:
        """All evidence of every group: (group_id, evidence_id)."""
        return grouping.evidence(self.alerts).join(self.alert_groups.select("dedup_key", "group_id"), "dedup_key").select("group_id", "evidence_id")

    @cached_property
    def triaged(self) -> DataFrame:
        return triage.triage(self.alert_groups)

    @cached_property
    def agent_runs(self) -> DataFrame:
        return triage.agent_runs(self.triaged, self.at)

    @cached_property
    def incidents(self) -> DataFrame:
        return save(triage.incidents(self.triaged, self.at), "incidents")

    @cached_property
    def incident_evidence(self) -> DataFrame:
        """All evidence of every incident, and so of its mapping, risk and plan: (incident_id, evidence_id)."""
        return self.group_evidence.join(self.incidents.select("group_id", "incident_id"), "group_id").select("incident_id", "evidence_id")

    @cached_property
    def control_mappings(self) -> DataFrame:
        return grc.control_mappings(self.incidents)

    @cached_property
    def risks(self) -> DataFrame:
        return grc.risks(self.incidents)

    @cached_property
    def action_plans(self) -> DataFrame:
        return save(remediation.action_plans(self.incidents, self.at), "plans")

    @cached_property
    def requests(self) -> DataFrame:
        return remediation.requests(self.action_plans, self.actor, self.at)

    @cached_property
    def policy_decisions(self) -> DataFrame:
        return policy.decide(self.requests, self.scope, self.at)


def run_flow(sources: DataFrame, scope: DataFrame | None = None, actor: str = policy.ACTOR, at: str = RUN_AT) -> Flow:
    """sources: name, source_type, media_type, source_ord, file_no, data. Time is a parameter, so that a replay gives the same rows."""
    return Flow(sources, policy.default_scope(sources.sparkSession) if scope is None else scope, actor, at)


def outcomes(flow: Flow, groups_per_flow: int | None = None) -> DataFrame:
    """One row per group with everything that came of it, and its flow: all groups in one, or so many in each."""
    incidents = flow.incidents.select("group_id", "incident_id", F.col("title").alias("incident_title"))
    mappings = flow.control_mappings.select("incident_id", "control_id")
    risks = flow.risks.select(F.col("related_incident_id").alias("incident_id"), "risk_id", "inherent_band")
    plans = flow.action_plans.select(F.col("created_from").alias("incident_id"), "action_plan_id", "action_type")
    decisions = flow.policy_decisions.select("action_plan_id", "effect", "reason_code")
    per = F.lit(1) if groups_per_flow is None else F.floor((F.col("group_no") - 1) / groups_per_flow) + 1
    after = incidents.join(mappings, "incident_id", "left").join(risks, "incident_id", "left").join(plans, "incident_id", "left").join(decisions, "action_plan_id", "left")
    return flow.triaged.select(number("FLOW", per.cast("long")).alias("flow_id"), "group_no", "group_id", "signature", "risk_score", "risk_band", "disposition", "confidence", "agent_run_id").join(after, "group_id", "left")


def flow_states(outcomes_: DataFrame) -> DataFrame:
    """Each flow's last status and incident: it waits for approval if any plan exists, else it is completed."""
    return outcomes_.groupBy("flow_id").agg(
        F.when(F.max(F.col("action_plan_id").isNotNull()), "waiting_for_approval").otherwise("completed").alias("status"), F.max_by("incident_id", F.when(F.col("incident_id").isNotNull(), F.col("group_no"))).alias("related_incident_id"),
        F.count("*").alias("groups"), F.count("incident_id").alias("incidents"), F.count("action_plan_id").alias("plans"))


def invariants(flow: Flow, chains: DataFrame) -> DataFrame:
    """The checks of a run as rows (name, passed): they hold over all rows or fail."""
    def holds(df: DataFrame, name: str, condition) -> DataFrame:
        return df.agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("passed")).select(F.lit(name).alias("name"), F.coalesce("passed", F.lit(True)).alias("passed"))

    out = holds(flow.alert_groups, "every group has evidence", F.col("evidence_count") > 0)
    for df, name, condition in (
        (flow.incidents, "every incident has evidence", F.col("evidence_count") > 0), (flow.action_plans, "every plan needs approval", F.col("requires_approval")), (flow.policy_decisions, "nothing is executed", F.col("effect") == "deny"), (chains, "every audit chain is intact", F.col("intact")),
    ):
        out = out.unionByName(holds(df, name, condition))
    return out


def run_report(flow: Flow, chains: DataFrame) -> DataFrame:
    """A run as rows (part, name, value): what came of it (summary), every group with its decision (group), and the checks (check: PASS or FAIL).

    Beyond `invariants`: the evidence is as it was stored, at least one incident was made, no plan has been executed, and a replay from the vault gives the same collections.
    """
    from vigilake.operators import replay

    row = lambda df, part, name, value: df.select(F.lit(part).alias("part"), name.alias("name"), value.cast("string").alias("value"))
    out = None
    for name, df in (("evidence", flow.evidence), ("alerts", flow.alerts), ("groups", flow.alert_groups), ("incidents", flow.incidents)):
        counted = row(df.agg(F.count("*").alias("n")), "summary", F.lit(name), F.col("n"))
        out = counted if out is None else out.unionByName(counted)
    done = outcomes(flow)
    said = F.concat_ws(" ", "disposition", F.col("confidence").cast("string"), F.coalesce("incident_id", F.lit("-")), F.coalesce("control_id", F.lit("-")), F.coalesce("action_plan_id", F.lit("-")), F.upper(F.coalesce("effect", F.lit("-"))), F.coalesce("reason_code", F.lit("-")))
    out = out.unionByName(row(done, "group", F.col("group_id"), said))
    vault = raw.vault(flow.evidence)
    again = run_flow(replay.rebuilt_sources(flow.evidence, vault), flow.scope, flow.actor, flow.at)
    judge = lambda df, name, ok: df.agg(F.coalesce(ok, F.lit(True)).alias("passed")).select(F.lit(name).alias("name"), "passed")
    checks = invariants(flow, chains).unionByName(judge(replay.integrity(flow.evidence.select("evidence_id", "storage_ref"), vault), "evidence integrity", F.bool_and("intact")))
    checks = checks.unionByName(judge(flow.incidents, "at least one incident", F.count("*") > 0)).unionByName(judge(flow.action_plans, "no plan has been executed", F.bool_and(F.col("status").isin("draft", "proposed"))))
    checks = checks.unionByName(judge(replay.compare(flow, again, COLLECTIONS), "a replay gives the same", F.bool_and("equal")))
    return out.unionByName(row(checks, "check", F.col("name"), F.when(F.col("passed"), "PASS").otherwise("FAIL")))


def exit_code(report: DataFrame) -> int:
    """What a run ends with: 0 if all checks of its report have passed, else 1."""
    return int(bool(report.where("part = 'check' AND value <> 'PASS'").take(1)))
