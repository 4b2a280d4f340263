"""Remediation: a plan from an incident's first recommended action, and the request that policy decides on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.knowledge import dimension
from vigilake.functions.text import BUCKET, canonical_json, number, numbered


def action_plans(incidents: DataFrame, at: str) -> DataFrame:
    """Plans of the known actions; always proposed, whatever policy decides, and always in need of approval."""
    first = incidents.withColumn("action_type", F.try_element_at("recommended_action_types", F.lit(1)))
    known = first.join(F.broadcast(dimension(incidents.sparkSession, "actions")), "action_type")
    found = numbered(known, ["incident_no"], F.floor(F.col("incident_no") / BUCKET), "plan_no")
    return found.select(
        number("AP", F.col("plan_no")).alias("action_plan_id"), "plan_no", F.col("plan_title").alias("title"), "action_type", "risk_level", F.lit("proposed").alias("status"), canonical_json(asset_id=F.col("asset_id")).alias("target"), "parameters", "rollback",
        F.lit(True).alias("requires_approval"), F.col("incident_id").alias("created_from"), "evidence_count", F.lit(at).alias("created_at"), "asset_id")


def requests(plans: DataFrame, actor: str, at: str) -> DataFrame:
    """The request to execute each plan now, without an approval. What it claims is carried along and decides nothing."""
    return plans.select(
        number("REQ", F.col("plan_no")).alias("request_id"), F.lit(actor).alias("actor"), "action_type", "risk_level", F.col("asset_id").alias("target"), "action_plan_id", F.lit(False).alias("has_approval"), F.lit(at).alias("at"),
        F.lit('{"note":"auto-remediation suggested by triage agent","pre_approved":true}').alias("claimed"))
