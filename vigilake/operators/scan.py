"""Text scanning: secrets and personal data by pattern, redaction, author metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions.knowledge import NO_CREDENTIALS, PLACEHOLDERS, SECRET_PATTERNS
from vigilake.functions.text import lines

MATCH_CHARS = 160
IDENTITY_KEYS = ("authorized_by", "requested_by", "uploaded_by", "submitted_by")


# fixed values: what a line must contain (one of these, in small letters) for a rule's pattern to be tried; each follows from the pattern
GUARDS = {
    "private-key": ("-----begin",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "aws-access-key": ("akia", "asia"), "openai-style-key": ("sk-",), "slack-token": ("xox",), "google-api-key": ("aiza",), "jwt": ("eyj",),
    "credential-assignment": ("passw", "pwd", "secret", "api", "access", "auth"), "email-address": ("@",), "mac-local-path": ("/users/",), "windows-local-path": (":\\users\\",), "private-ipv4": ("10.", "192.168.", "172."),
}


def _any_of(low: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts))


def _finding(k: int, severity: str, rule: str):
    return lambda m, i: F.struct((F.lit(k * 100_000) + i).alias("k"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.left(m, F.lit(MATCH_CHARS)).alias("match"))


def findings(texts: DataFrame, skip_placeholders: bool = True) -> DataFrame:
    """Every match of every pattern in texts (location, text): severity, rule, location, line, match, and place for a stable order.

    Lines with a placeholder are skipped; credentials with a value that is none are left out.
    """
    rows = texts.select("location", F.posexplode(lines(F.col("text"))).alias("n", "line"))
    low = F.lower("line")
    # few lines contain any of these: only they are matched, and only by the patterns that they may fit
    rows = rows.where(reduce(lambda a, b: a | b, (_any_of(low, g) for g in GUARDS.values())))
    if skip_placeholders:
        for p in PLACEHOLDERS:
            rows = rows.where(~F.contains(low, F.lit(p)))
    each = []
    for k, (severity, rule, pattern) in enumerate(SECRET_PATTERNS):
        hits = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        if rule == "credential-assignment":
            value = lambda m: F.lower(F.regexp_replace(F.regexp_replace(m, r"^[^:=]*[:=]\s*[\"']?", ""), r"[\"']$", ""))
            hits = F.filter(hits, lambda m: ~value(m).isin(*NO_CREDENTIALS))
        found = F.transform(hits, _finding(k, severity, rule))
        each.append(F.when(_any_of(low, GUARDS[rule]), found))
    found = rows.select("location", (F.col("n") + 1).alias("line"), F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("f"))
    return found.select("f.severity", "f.rule", "location", "line", "f.match", F.col("f.k").alias("place"))


def has_secret(text: Column) -> Column:
    """Whether a text has a match of a pattern of high severity."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (_any_of(low, GUARDS[rule]) & F.regexp_like(text, F.lit(pattern)) for severity, rule, pattern in SECRET_PATTERNS if severity == "HIGH"))


def rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).when(severity == "INFO", 2).otherwise(9)


def report(found: DataFrame) -> DataFrame:
    return found.orderBy(rank(F.col("severity")), "location", "line", "place")


def counts(found: DataFrame) -> DataFrame:
    """Findings per severity, zeros included."""
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "INFO")))


def threshold(found: DataFrame) -> DataFrame:
    """Whether a check fails that looks for (fail_on) high findings, medium ones or worse, or none at all."""
    c = counts(found)
    each = F.array(*(F.struct(F.lit(k).alias("fail_on"), v.alias("failed")) for k, v in (("high", F.col("high") > 0), ("medium", F.col("high") + F.col("medium") > 0), ("never", F.lit(False)))))
    return c.select(F.explode(each).alias("x")).select("x.fail_on", "x.failed")


def write_report(found: DataFrame, path: str) -> None:
    """The report in its order, as JSON lines in a new folder."""
    report(found).write.json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """A report in the order of its files and lines: its columns, position (from 1), and in_order: it stands after the one before it as `report` orders them.

    A file's lines keep their order in one task; the first line of a file is compared with the last one of the file before it.
    """
    # a file is one partition's lines from its start: ids ascend within it
    rows = spark.read.schema(schema).option("wholetext", "false").json(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    sizes = rows.groupBy("__file").agg(F.count("*").alias("__n"))  # one row for each file
    before = sizes.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"))
    inner = Window.partitionBy("__file").orderBy("__block", "__row")
    key = F.struct(rank(F.col("severity")).alias("rank"), "location", "line", "place")
    out = rows.join(before, "__file").withColumns({"position": F.row_number().over(inner) + F.col("__before"), "__key": key})
    ends = out.groupBy("__file").agg(F.max_by("__key", "position").alias("__last"), F.min("position").alias("__first"))
    ends = ends.select("__file", F.lag("__last").over(Window.orderBy("__file")).alias("__end"))
    last = F.coalesce(F.lag("__key").over(inner), F.col("__end"))
    out = out.join(ends, "__file").withColumn("in_order", F.coalesce(F.col("__key") >= last, F.lit(True)))
    return out.drop("__file", "__block", "__row", "__before", "__key", "__end")


def exit_code(found: DataFrame, fail_on: str) -> int:
    """What a check of that strictness (high, medium or never) ends with: 1 if it fails."""
    return int(threshold(found).where(F.col("fail_on") == fail_on).first().failed)


#: Histories of more bytes are not scanned.
MAX_HISTORY_BYTES = 25_000_000


def history_findings(texts: DataFrame, most: int = MAX_HISTORY_BYTES) -> DataFrame:
    """Findings of histories (history, seq, text: its pieces), a history of more than `most` bytes giving one row that says so."""
    sizes = texts.groupBy("history").agg((F.sum(F.octet_length("text").cast("long")) > most).alias("large"))
    where = F.concat(F.lit("history:"), "history")
    found = findings(texts.join(sizes.where("not large"), "history").select(F.to_json(F.struct("history", "seq")).alias("location"), "text"))
    at = F.from_json("location", "history string, seq long")
    found = found.select("severity", "rule", F.concat(F.lit("history:"), at["history"]).alias("location"), at["seq"].alias("seq"), "line", "match")
    skipped = sizes.where("large").select(F.lit("INFO").alias("severity"), F.lit("history-scan-skipped").alias("rule"), where.alias("location"), F.lit(None).cast("long").alias("seq"), F.lit(0).alias("line"), F.format_string("History exceeds %d bytes", F.lit(most)).alias("match"))
    return found.unionByName(skipped)


def author_findings(commits: DataFrame) -> DataFrame:
    """The first commit of each (name, email) whose address is neither hidden nor seen before: commits (seq, hash, name, email)."""
    first = commits.withColumn("__n", F.row_number().over(Window.partitionBy("name", "email").orderBy("seq"))).where("__n = 1")
    first = first.where(~F.endswith("email", F.lit("@users.noreply.github.com")))
    local = F.endswith("email", F.lit(".local")) | F.contains("email", F.lit(".local@"))
    return first.select(F.when(local, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit("commit-author-email").alias("rule"), F.concat(F.lit("git-commit:"), F.left("hash", F.lit(12))).alias("location"), F.lit(0).alias("line"), F.concat("name", F.lit(" <"), "email", F.lit(">")).alias("match"))


def redacted(text: Column, home: str = "", to: str = "security-operator") -> Column:
    """Identity fields of JSON text neutralised, and a home folder's path replaced."""
    out = F.regexp_replace(text, rf'("(?:{"|".join(IDENTITY_KEYS)})"\s*:\s*")([^"]+)(")', rf"$1{to}$3")
    if home:
        out = F.replace(F.replace(out, F.lit(home + "/"), F.lit("/home/example-user/")), F.lit(home + "\\"), F.lit("C:\\Users\\example-user\\"))
    return out
