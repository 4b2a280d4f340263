"""Parsers: raw lines to alerts of one shape. A registry by source type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.knowledge import EVE_SEVERITY, MONTHS, YEAR, lookup
from vigilake.functions.text import number, numbered
from vigilake.sources.store import save

#: month, day, time, host, user, address of a failed SSH login
SSH = r"(?U)^(\w{3})\s+(\d+)\s+([\d:]+)\s+(\S+)\s+sshd\[\d+\]:\s+Failed password for (\S+) from (\d+\.\d+\.\d+\.\d+)"
_KEYS = ("evidence_id", "source_ord", "file_no", "line_no")
#: The keys of a JSON alert.
_PATHS = {"src": "$.src_ip", "rule": "$.alert.signature_id", "dest": "$.dest_ip", "title": "$.alert.signature", "level": "$.alert.severity", "time": "$.timestamp"}
#: Files whose alerts are numbered by one task at a time.
FILES_NUMBERED = 50
ALERT = ("source", "signature", "title", "asset_id", "host", "severity", "event_time", "dedup_key")


def auth_alerts(lines: DataFrame) -> DataFrame:
    """Failed SSH logins; other lines are left out. An unknown month is an error."""
    part = lambda k: F.col("__parts")[k - 1]
    month = lookup(part(1), {m: i for i, m in enumerate(MONTHS, 1)}, F.raise_error(F.concat(F.lit("unknown month "), part(1))).cast("int"))
    time = F.format_string("%04d-%02d-%02dT%sZ", F.lit(YEAR), month, part(2).cast("int"), part(3))
    # no group can have a space in it; all six are found by one match
    found = lines.where(F.col("line").rlike(SSH)).select(*_KEYS, F.split(F.regexp_replace("line", f"{SSH}(?s:.*)", "$1 $2 $3 $4 $5 $6"), " ").alias("__parts"))
    return found.select(
        *_KEYS, F.lit("linux_auth").alias("source"), F.lit("ssh_failed_password").alias("signature"), F.concat(F.lit("Failed SSH password for "), part(5), F.lit(" from "), part(6)).alias("title"),
        part(4).alias("asset_id"), part(4).alias("host"), F.lit("medium").alias("severity"), time.alias("event_time"), F.concat_ws(":", F.lit("ssh_failed_password"), part(4), part(6)).alias("dedup_key"))


def eve_alerts(lines: DataFrame) -> DataFrame:
    """JSON alerts; blank lines and other event types are left out, a malformed line is an error.

    Defaults stand for keys that are missing. A key that is present with null is an error where a text is required
    (src_ip, signature, severity, timestamp), and the text None in the dedup key elsewhere.
    """
    v = F.col("v")

    def get(name: str, default: str, kind: str = "string", null: Column | None = None) -> Column:
        path = _PATHS[name]
        given = F.try_variant_get(v, path, "variant")  # looked at only where there is no value
        bad = F.raise_error(F.lit(f"{path} is null")).cast(kind) if null is None else null
        return F.coalesce(F.try_variant_get(v, path, kind), F.when(given.isNull(), F.lit(default).cast(kind)).when(F.is_variant_null(given), bad).otherwise(F.variant_get(v, path, kind)))

    # exploded, so that Spark does not parse each line once more in a filter that it moves down
    parsed = lines.where(F.col("line") != "").select(*_KEYS, F.explode(F.array(F.parse_json("line"))).alias("v"))
    found = parsed.where(F.try_variant_get(v, "$.event_type", "string") == "alert")
    none = F.lit("None")
    got = found.select(
        *_KEYS, get("src", "unknown").alias("src"), get("rule", "0", null=none).alias("rule"), get("dest", "unknown", null=none).alias("dest"), get("title", "Suricata alert").alias("title"), get("level", "3", "int").alias("level"), get("time", "").alias("time"))
    return got.select(
        *_KEYS, F.lit("suricata_eve").alias("source"), F.lit("suspicious_outbound_tls").alias("signature"), "title", F.col("src").alias("asset_id"), F.col("src").alias("host"), lookup(F.col("level"), EVE_SEVERITY, F.lit("low")).alias("severity"),
        F.replace("time", F.lit("+0000"), F.lit("Z")).alias("event_time"), F.concat_ws(":", F.lit("suspicious_outbound_tls"), "rule", "src", "dest").alias("dedup_key"))


PARSERS = {"linux_auth": auth_alerts, "suricata_eve": eve_alerts}


def parse(lines: DataFrame, parsers: dict = PARSERS) -> DataFrame:
    """All alerts of lines (evidence_id, source_ord, file_no, source_type, line_no, line), numbered in the order of sources and lines."""
    found = None
    for kind, parser in parsers.items():
        part = parser(lines.where(F.col("source_type") == kind))
        found = part if found is None else found.unionByName(part)
    found = save(found, "parsed")  # numbering reads its input twice
    bucket = F.col("source_ord").cast("long") * 1_000_000_000 + F.floor(F.col("file_no") / FILES_NUMBERED)
    out = numbered(found, ["source_ord", "file_no", "line_no"], bucket)
    return out.select(number("ALERT", F.col("seq")).alias("alert_id"), "seq", *ALERT, F.array("evidence_id").alias("evidence_ids"))


#: Keys of a JSON alert that may be absent but not null, and the one that must be a whole number.
TEXT_KEYS, NUMBER_KEY = ("$.src_ip", "$.alert.signature", "$.timestamp"), "$.alert.severity"


def _auth_reason() -> Column:
    month = F.col("__month")  # empty where the line is none of a failed login
    return F.when((month != "") & ~month.isin(*MONTHS), "unknown_month")


def _eve_reason() -> Column:
    v, kind = F.col("__v"), F.col("__kind")
    null = F.lit(False)
    for path in (*TEXT_KEYS, NUMBER_KEY):
        null = null | F.coalesce(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(False))
    number = F.try_variant_get(v, NUMBER_KEY, "variant").isNotNull() & F.try_variant_get(v, NUMBER_KEY, "int").isNull()
    alert = kind == "alert"
    blank = F.col("line") == ""
    # what has an event type is an object: the others alone have their schema looked up
    other = kind.isNull() & ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.when(blank, F.lit(None)).when(v.isNull(), "not_json").when(other, "not_an_object").when(alert & null, "null_value").when(alert & number, "no_number")


REASONS = {"linux_auth": _auth_reason, "suricata_eve": _eve_reason}


def with_reasons(lines: DataFrame) -> DataFrame:
    """lines with reason: why a line cannot be parsed; null if it can, or if it is one that the parser leaves out."""
    reason = F.lit(None).cast("string")
    for kind, why in REASONS.items():
        reason = F.when(F.col("source_type") == kind, why()).otherwise(reason)
    # columns of their own: each line is parsed once
    is_ = lambda kind: F.col("source_type") == kind
    read = lines.withColumns({"__v": F.when(is_("suricata_eve"), F.try_parse_json("line")), "__month": F.when(is_("linux_auth"), F.regexp_extract("line", SSH, 1))})
    read = read.withColumn("__kind", F.try_variant_get("__v", "$.event_type", "string"))
    return read.select(*lines.columns, reason.alias("reason"))


def parse_sound(marked: DataFrame) -> DataFrame:
    """The alerts of lines that can be parsed (marked: a table of `with_reasons`); where `parse` stops at the first malformed line, the others go on."""
    return parse(marked.where("reason is null").drop("reason"))


def quarantined(marked: DataFrame) -> DataFrame:
    """The lines that cannot be parsed: (evidence_id, line_no, reason, line); with the evidence they can be looked at and read again."""
    return marked.where("reason is not null").select("evidence_id", "line_no", "reason", "line")


def line_totals(marked: DataFrame, alerts: DataFrame) -> DataFrame:
    """(evidence_id, lines, blank, alerts, left_out, quarantined): what became of each file's lines; they add up."""
    found = alerts.select(F.explode("evidence_ids").alias("evidence_id")).groupBy("evidence_id").agg(F.count("*").alias("alerts"))
    c = marked.groupBy("evidence_id").agg(F.count("*").alias("lines"), F.count_if((F.col("line") == "") & F.col("reason").isNull()).alias("blank"), F.count("reason").alias("quarantined"))
    out = c.join(found, "evidence_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0).cast("long")))
    return out.withColumn("left_out", F.col("lines") - F.col("blank") - F.col("alerts") - F.col("quarantined"))
