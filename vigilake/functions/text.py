"""Text, hash, id and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What ends a line: the same set as Python's str.splitlines.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Those of them that few texts have.
RARE_ENDS = "\r\u000b\u000c\u001c\u001d\u001e\u0085  "
#: Rows numbered by one task at a time, if keys are spread evenly.
BUCKET = 1_000_000


def decoded(data: Column) -> Column:
    """Bytes as text, with invalid sequences replaced."""
    return F.make_valid_utf8(data.cast("string"))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end starts no further line."""
    return whole_lines(F.split(text, LINE_ENDS))


def split_at_ends(text: Column) -> Column:
    """A text split at its line ends; no pattern is run over one that has only the common one. text is read several times: it should be a column of its own."""
    rare = F.lit(False)
    for end in RARE_ENDS:
        rare = rare | F.contains(text, F.lit(end))
    return F.when(rare, F.split(text, LINE_ENDS)).otherwise(F.split(text, "\n"))


def whole_lines(parts: Column) -> Column:
    """What a text was split into at its line ends, without the empty rest after the last one."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def content_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, no white space and nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def number(prefix: str, n: Column) -> Column:
    return F.format_string(f"{prefix}-%04d", n)


#: A side with at most this many slim rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: list[str], bucket: Column, name: str = "seq") -> DataFrame:
    """df with a dense number from 1 in the given order.

    bucket: an expression that never falls along the order. Rows are numbered within their bucket, and the buckets'
    sizes are added up, so that no task sorts all rows. There is one row per bucket (some BUCKET rows); Spark broadcasts them
    if they are small enough. df is read twice, of which once for the bucket's columns alone: it should be a table.
    """
    df = df.withColumn("__bucket", bucket)
    sizes = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    out = df.join(before, "__bucket").withColumn(name, F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) + F.col("__before"))
    return out.drop("__bucket", "__before")
