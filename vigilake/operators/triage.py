"""Triage: an ordered rule set per group, a gate before an escalation may become an incident."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.knowledge import ATTACK_TECHNIQUES, lookup
from vigilake.functions.text import BUCKET, canonical_json, number, numbered

MIN_CONFIDENCE = 0.5


@dataclass(frozen=True)
class Agent:
    """A named, versioned rule set: from a group's columns to struct<disposition, confidence, rationale, recommended_action_types>."""

    name: str
    version: str
    decide: Callable[[], Column]

    def judge(self, groups: DataFrame) -> DataFrame:
        """groups with the columns of the result."""
        return groups.withColumn("__r", self.decide()).select("*", "__r.*").drop("__r")


def _soc_rules() -> Column:
    """The first rule that holds decides. Without evidence nothing is escalated."""
    none = F.array().cast("array<string>")

    def result(disposition: str, confidence: float, rationale: Column, actions: Column = none) -> Column:
        return F.struct(F.lit(disposition).alias("disposition"), F.lit(confidence).alias("confidence"), rationale.alias("rationale"), actions.alias("recommended_action_types"))

    high = F.col("risk_band").isin("high", "critical")
    return (
        F.when(F.coalesce("evidence_count", F.lit(0)) <= 0, result("monitor", 0.3, F.lit("No linked evidence; defaulting to monitor.")))
        .when((F.col("signature") == "ssh_failed_password") & (F.col("count") >= 3), result("escalate", 0.85, F.concat(F.col("count").cast("string"), F.lit(" repeated SSH authentication failures for the same source/host indicate credential brute force (T1110).")), F.array(F.lit("harden_ssh_access"))))
        .when(high, result("escalate", 0.7, F.concat(F.lit("Risk band "), "risk_band", F.lit(" warrants analyst escalation."))))
        .otherwise(result("monitor", 0.6, F.concat(F.lit("Risk band "), "risk_band", F.lit("; monitor and enrich before escalation."))))
    )


AGENTS = {"soc.triage": Agent("soc.triage", "0.2.0", _soc_rules)}


def resolve(name: str, version: str | None = None) -> Agent:
    agent = AGENTS[name]
    if version is not None and version != agent.version:
        raise KeyError(f"{name} has version {agent.version}, not {version}")
    return agent


def resolutions(wanted: DataFrame) -> DataFrame:
    """wanted (name, version; version null: any) with outcome: ok, unknown or other_version, as `resolve` decides, and the registered version."""
    known = wanted.sparkSession.createDataFrame([(a.name, a.version) for a in AGENTS.values()], "name string, registered string")
    out = wanted.join(F.broadcast(known), "name", "left")  # the registry is a table of this module
    return out.withColumn("outcome", F.when(F.col("registered").isNull(), "unknown").when(F.col("version") != F.col("registered"), "other_version").otherwise("ok"))


def triage(groups: DataFrame, agent=None) -> DataFrame:
    """groups with disposition, confidence, rationale, recommended_action_types, attack_techniques and the number of the run.

    agent: an `Agent`, or any that has name, version and judge (such as `model_agent.ModelAgent`).
    """
    agent = agent or resolve("soc.triage")
    none = F.array().cast("array<string>")
    return agent.judge(groups).withColumns({"attack_techniques": F.coalesce(lookup(F.col("signature"), ATTACK_TECHNIQUES), none), "agent_run_id": number("AR", F.col("group_no"))})


def agent_runs(triaged: DataFrame, at: str, agent=None) -> DataFrame:
    agent = agent or resolve("soc.triage")
    output = canonical_json(disposition=F.col("disposition"), attack_techniques=F.col("attack_techniques"), recommended_action_types=F.col("recommended_action_types"))
    return triaged.select("agent_run_id", F.lit(agent.name).alias("agent_name"), F.lit(agent.version).alias("agent_version"), F.array("group_id").alias("input_refs"), output.alias("output"), "confidence", "evidence_count", F.lit("ok").alias("status"), F.lit(at).alias("started_at"), F.lit(at).alias("finished_at"))


def may_escalate() -> Column:
    """The gate: evidence, and enough confidence. Unknown means no."""
    return F.coalesce((F.col("evidence_count") > 0) & (F.col("confidence") >= MIN_CONFIDENCE), F.lit(False))


def incidents(triaged: DataFrame, at: str) -> DataFrame:
    """One incident per escalated group that passes the gate, numbered in the order of groups; keeps signature and actions for the next stages."""
    found = numbered(triaged.where(F.col("disposition") == "escalate").where(may_escalate()), ["group_no"], F.floor(F.col("group_no") / BUCKET), "incident_no")
    return found.select(
        number("INC", F.col("incident_no")).alias("incident_id"), "incident_no", "group_no", F.concat("signature", F.lit(" on "), "asset_id").alias("title"), "severity", F.lit("open").alias("status"), "asset_id", F.array("group_id").alias("alert_group_ids"), "evidence_count",
        F.col("agent_run_id").alias("triage_ref"), "attack_techniques", F.lit(at).alias("created_at"), "signature", "recommended_action_types", "group_id")
