"""Governance: incidents mapped to controls, and candidates for the risk register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.knowledge import BAND_BY_SEVERITY, dimension, lookup
from vigilake.functions.text import BUCKET, number, numbered

MAPPING_CONFIDENCE = 0.8


def control_mappings(incidents: DataFrame) -> DataFrame:
    """One mapping per incident whose signature has a control in the library."""
    spark = incidents.sparkSession
    joined = incidents.join(F.broadcast(dimension(spark, "signature_controls")), "signature").join(F.broadcast(dimension(spark, "controls")), "control_id")
    found = numbered(joined, ["incident_no"], F.floor(F.col("incident_no") / BUCKET), "mapping_no")
    why = F.concat(F.lit("Incident evidences control "), "control_id", F.lit(" ("), "control_title", F.lit(")."))
    return found.select(number("MAP", F.col("mapping_no")).alias("mapping_id"), "incident_id", "control_id", F.lit(MAPPING_CONFIDENCE).alias("confidence"), why.alias("rationale"), "evidence_count")


def risks(incidents: DataFrame) -> DataFrame:
    """One risk per incident; its band follows the incident's severity."""
    seen = F.coalesce(F.nullif(F.array_join("attack_techniques", ", "), F.lit("")), F.lit("n/a"))
    statement = F.concat(F.lit("Observed activity ("), seen, F.lit(") on "), "asset_id", F.lit(" could lead to compromise if unaddressed."))
    return incidents.select(
        number("RISK", F.col("incident_no")).alias("risk_id"), F.concat(F.lit("Exposure from "), "title").alias("title"), statement.alias("statement"), F.lit("medium").alias("likelihood"), F.col("severity").alias("impact"),
        lookup(F.col("severity"), BAND_BY_SEVERITY).alias("inherent_band"), F.lit(None).cast("string").alias("owner"), F.lit("open").alias("treatment_status"), F.lit(None).cast("string").alias("residual_band"), F.col("incident_id").alias("related_incident_id"), "evidence_count")
