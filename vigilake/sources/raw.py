"""Raw sources: files of log lines or newline-delimited JSON, kept as evidence under their content hash."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.text import content_hash, decoded, number, numbered, split_at_ends, whole_lines
from vigilake.sources.store import save

#: Source types with a parser, in the order in which they are read.
ORDER = {"linux_auth": 0, "suricata_eve": 1}
#: Events rendered into one raw file by `event_sources`.
EVENTS_PER_FILE = 1000
#: Stored bytes of a row group of the table of raw sources; logs take some 13 times as much when they are read.
BLOCK = 1 << 20
#: Files larger than this, or with a NUL among their first bytes, are not scanned as text.
MAX_FILE_BYTES, HEAD_BYTES = 2_000_000, 8192
SKIPPED_PREFIXES = (".git/", ".venv/", "venv/", "node_modules/", "runtime-data/", "uploads/", "evidence/", "artifacts/", ".local-audit/")


def read_sources(spark: SparkSession, path: str, source_type: str, media_type: str = "text/plain") -> DataFrame:
    """Whole files as raw sources (name, source_type, media_type, data), numbered by name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("name"), F.lit(source_type).alias("source_type"), F.lit(media_type).alias("media_type"), F.col("content").alias("data"))


def scannable_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files below a folder (location, text): none that is too large, binary, or under a skipped prefix."""
    root = re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_FILE_BYTES)
    location = F.substring_index(F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:/+", "/"), root, -1)
    skipped = F.lit(False)
    for p in SKIPPED_PREFIXES:
        skipped = skipped | F.startswith("location", F.lit(p))
    zero = F.instr(F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1"), "\x00") > 0
    return files.withColumn("location", location).where(~skipped & ~zero).select("location", decoded(F.col("content")).alias("text"))


def checked_sources(sources: DataFrame) -> DataFrame:
    """sources, failing on a type without a parser before anything is stored."""
    known = F.col("source_type").isin(*ORDER)
    return sources.withColumn("source_type", F.when(known, F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("no parser for source type "), F.coalesce("source_type", F.lit("null"))))))


def with_evidence(sources: DataFrame, captured_at: str) -> DataFrame:
    """sources (name, source_type, media_type, source_ord, file_no, data) with their evidence record's columns."""
    columns = sources.columns
    # rendered and hashed once, in small row groups, which readers share among their tasks
    sources = save(sources.withColumns({"content_hash": content_hash(F.col("data")), "size_bytes": F.octet_length("data").cast("long"), "__row": F.monotonically_increasing_id()}), "sources", block=BLOCK)
    # the files are numbered without their data, which is neither sorted nor shuffled
    places = numbered(sources.select("__row", "source_ord", "file_no"), ["source_ord", "file_no"], F.col("source_ord") * 1_000_000 + F.floor(F.col("file_no") / 10_000), "evidence_no")
    ordered = sources.join(save(places.select("__row", "evidence_no"), "places"), "__row")
    return ordered.select(*columns, "content_hash", "evidence_no", number("EVID", F.col("evidence_no")).alias("evidence_id"), "size_bytes", F.lit(captured_at).alias("captured_at"), F.col("content_hash").alias("storage_ref"))


def vault(sources: DataFrame) -> DataFrame:
    """Blobs by content hash, identical bytes once: ref, data."""
    return sources.select(content_hash(F.col("data")).alias("ref"), "data").groupBy("ref").agg(F.max("data").alias("data"))


def source_lines(evidence: DataFrame) -> DataFrame:
    """One row per line: evidence_id, source_ord, file_no, source_type, line_no, line (ends trimmed)."""
    texts = evidence.select("evidence_id", "source_ord", "file_no", "source_type", decoded(F.col("data")).alias("__text"))
    split = texts.select("evidence_id", "source_ord", "file_no", "source_type", split_at_ends(F.col("__text")).alias("__parts"))  # a column of its own: each text is split once
    return split.select("evidence_id", "source_ord", "file_no", "source_type", F.posexplode(whole_lines(F.col("__parts"))).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _auth_line(ts: Column) -> Column:
    user = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("invalid user u"), "user_id")).otherwise(F.concat(F.lit("u"), "user_id"))
    host = F.when(F.col("event_id") % 6 == 1, F.lit("web-01")).otherwise(F.concat(F.lit("host-"), (F.col("event_id") % 6).cast("string")))
    stamp = F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.date_format(ts, "d"), 2, " "), F.lit(" "), F.date_format(ts, "HH:mm:ss"))
    return F.concat(stamp, F.lit(" "), host, F.lit(" sshd["), (F.col("event_id") + 100).cast("string"), F.lit("]: Failed password for "), user, F.lit(" from 198.51.100."), (F.col("user_id") % 250).cast("string"), F.lit(" port 22 ssh2"))


def _eve_line(ts: Column) -> Column:
    n, u = F.col("event_id"), F.col("user_id")
    return F.concat(
        F.lit('{"timestamp":"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('+0000","event_type":"'), F.when(F.col("event_type") == "view", "flow").otherwise("alert"), F.lit('","src_ip":"192.0.2.'), (u % 40).cast("string"), F.lit('"'),
        F.when(F.col("event_type") == "purchase", "").otherwise(F.concat(F.lit(',"dest_ip":"203.0.113.'), (n % 4).cast("string"), F.lit('"'))),
        F.lit(',"alert":{"signature_id":'), (u % 20 + 1000).cast("string"),
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit(',"severity":'), (n % 3 + 1).cast("string"))),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(',"signature":"rule '), (u % 20).cast("string"), F.lit('"'))), F.lit("}}"),
    )


def event_sources(events: DataFrame, per_file: int = EVENTS_PER_FILE) -> DataFrame:
    """The events table rendered as raw files: error events as auth log lines, the others as JSON alerts, per_file events to a file at most."""
    ts = F.col("ts").cast("timestamp")
    is_error = F.col("event_type") == "error"
    rows = events.select("event_id", F.when(is_error, "linux_auth").otherwise("suricata_eve").alias("source_type"), F.when(is_error, _auth_line(ts)).otherwise(_eve_line(ts)).alias("line"), F.floor(F.col("event_id") / per_file).alias("file_no"))
    files = rows.groupBy("source_type", "file_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return files.select(
        F.concat("source_type", F.lit("-"), F.col("file_no").cast("string")).alias("name"), "source_type", F.when(F.col("source_type") == "linux_auth", "text/plain").otherwise("application/x-ndjson").alias("media_type"),
        F.when(F.col("source_type") == "linux_auth", 0).otherwise(1).alias("source_ord"), "file_no", F.encode("text", "UTF-8").alias("data"))
