"""Merkle dataset manifest: a hash tree per source and one over the sources, with every row's proof and its check.

A leaf is the hash of a row's fields, each with its length. Rows are placed within their source in order of doc_id by range
partitions, so that a source with a large share of all rows is dealt over many tasks. A level is one window: partitioned by
group and parent, its ordered list over the full frame is the parent's preimage and holds every child's siblings. The first
child then stands for its parent, so that a level has a sixteenth of the rows of the one below.

On the way down each parent hands its children the steps that lead to the root; a row meets the rest of its proof by one
join with the first level, a sixteenth of the rows. Digests are kept as 32 bytes and written as hex where they are hashed.

Defined results: a null field is hashed as `-`; rows with a null doc_id come first in their source and are never tampered
with; rows without a source are a group of their own, which comes first; rows that repeat an id are ordered by their leaf,
so that equal rows get equal leaves and each its own proof; a lone row is its source's root and has no siblings (the
proof is the hash of nothing); other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import save, table

#: Children of a node, and the fields of a leaf in their order.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The demonstration tampers with rows whose id's checksum this divides.
TAMPERED = 5


def _hash(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(bytearray()), lambda a, x: F.concat(a, x))


def leaf(**other: Column) -> Column:
    """The hash of a row's fields; other: what to hash for a field instead."""
    parts = [other.get(c, F.col(c)).cast("string") for c in FIELDS]
    return _hash(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in parts)))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, the place from 0 within grp in the given order (which begins with grp), and n, the group's rows.

    The range partitions are written with their numbers before they are counted: what is counted is what is placed.
    """
    by = [*order, "tie"]  # equal rows can be dealt over several partitions
    dealt = save(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "dealt")
    group = Window.partitionBy("grp")
    sizes = dealt.groupBy("grp", "part").agg(F.count("*").alias("c")).select("grp", "part", (F.sum("c").over(group.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("n"))
    idx = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*by)) - 1 + F.col("before")
    return save(dealt.join(sizes, ["grp", "part"]).withColumn("idx", idx).drop("part", "before", "tie"), "placed")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels above leaves (grp, idx, n, node): each (grp, idx, n, node, children) of groups that have more than one node below."""
    levels, nodes, most = [], leaves, leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        family = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        up = nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FANOUT}")).withColumn("children", F.collect_list("node").over(family))
        up = up.where(F.col("idx") % FANOUT == 0).select("grp", F.col("parent").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), _hash(_hex(_joined(F.col("children")))).alias("node"), "children")
        levels.append(save(up, "level"))
        nodes, most = levels[-1], -(-most // FANOUT)
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, top): each group's last node."""
    out = leaves.where("n = 1").select("grp", F.col("node").alias("top"))
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("grp", F.col("node").alias("top")))
    return out


def _with_steps(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """nodes (grp, idx, n, ...) with the columns of above (grp, steps, ...): steps, the siblings left and right of each node on the way up, go on from the node to its group's top and beyond it."""
    more = [c for c in above.columns if c not in ("grp", "steps")]
    out = nodes.where("n = 1").join(above, "grp")
    if levels:
        parents = _with_steps(levels[0], levels[1:], above)
        if len(levels) > 1:
            parents = save(parents, "steps")
        parents = parents.select("grp", F.col("idx").alias("parent"), F.col("children").alias("family"), F.col("steps").alias("rest"), *more)
        place = (F.col("idx") % FANOUT).cast("int")
        step = F.struct(_joined(F.slice("family", F.lit(1), place)).alias("left"), _joined(F.slice("family", place + 2, F.lit(FANOUT))).alias("right"))
        met = nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FANOUT}")).join(parents, ["grp", "parent"])
        out = out.unionByName(met.withColumn("steps", F.concat(F.array(step), "rest")).drop("family", "rest", "parent"))
    return out


def proof(steps: Column) -> Column:
    """The hash of the siblings, level by level, left to right."""
    return F.sha2(_hex(F.aggregate(steps, F.lit(bytearray()), lambda a, s: F.concat(a, s["left"], s["right"]))), 256)


def folded(node: Column, steps: Column) -> Column:
    """The root (hex) that a node (bytes) and its steps give."""
    return F.aggregate(steps, _hex(node), lambda a, s: F.sha2(F.concat(_hex(s["left"]), a, _hex(s["right"])), 256))


def manifest(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """One row per row of docs (FIELDS): doc_id, leaf, forged, subroot, root (bytes), and the steps of its proof.

    forged: another leaf to carry along (bytes; null: none), such as that of the row as it is found later.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # in order of bytes, null first
    rows = save(docs.select("doc_id", source.alias("grp"), leaf().alias("node"), (F.lit(None).cast("binary") if forged is None else forged).alias("forged")), "hashed")
    leaves = _placed(rows, ["grp", "doc_id", "node"])
    levels = _levels(leaves)
    subroots = save(_tops(leaves, levels), "subroots")
    sources = _placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("top").alias("node")), ["grp", "source"])
    upper = _levels(sources)
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    start = _tops(sources, upper).select("grp", none.alias("steps"), F.col("top").alias("root"))  # a single row
    above = save(_with_steps(sources, upper, start).select(F.col("source").alias("grp"), "steps", F.col("node").alias("subroot"), "root"), "above")
    return _with_steps(leaves, levels, above).select("doc_id", F.col("node").alias("leaf"), "forged", "subroot", "root", "steps")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, checked against rows of which some had their text lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, leaf(text=lower))
    m = manifest(table(spark, sf_dir, "documents"), forged)
    again = folded(F.coalesce("forged", "leaf"), F.col("steps"))
    out = m.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), proof(F.col("steps")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# the twin goes this many levels up within a source and over the sources: more than a million rows to a source, 4096 sources
_DEEP, _WIDE = 5, 3


def _tree_sql(name: str, leaves: str, deep: int) -> str:
    """Levels name0.. of leaves (grp, idx, n, h), each node with l and r, its siblings' text, and n, the group's nodes on that level."""
    out, below = [], leaves
    for k in range(deep + 1):
        out.append(f"""{name}{k} AS (
  SELECT grp, idx, n, h, array_to_string(hs[1:idx % 16], '') AS l, array_to_string(hs[idx % 16 + 2:], '') AS r
  FROM (SELECT *, list(h ORDER BY idx) OVER (PARTITION BY grp, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hs FROM ({below})))""")
        below = f"SELECT grp, idx // 16 AS idx, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k} WHERE n > 1 GROUP BY grp, idx // 16, n"
    return ",\n".join(out)


def _sql() -> str:
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf_sql = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    # each level's fold is a column of its own: nested expressions would double with every level
    steps, joins, before = [], [], "x0"
    for k, (name, key) in enumerate([*((f"s{k}", f"d.grp = s{k}.grp AND d.idx // {16**k} = s{k}.idx") for k in range(_DEEP)), *((f"t{k}", f"d.place // {16**k} = t{k}.idx") for k in range(_WIDE))]):
        joins.append(f"LEFT JOIN {name} ON {key}")
        steps.append(f"x{k + 1} AS (SELECT * REPLACE (CASE WHEN lr[{k + 1}] IS NULL THEN f ELSE sha256(lr[{k + 1}].l || f || lr[{k + 1}].r) END AS f, p || coalesce(lr[{k + 1}].l || lr[{k + 1}].r, '') AS p) FROM {before})")
        before = f"x{k + 1}"
    lr = ", ".join(f"CASE WHEN {name}.n > 1 THEN {{'l': {name}.l, 'r': {name}.r}} END" for name in [*(f"s{k}" for k in range(_DEEP)), *(f"t{k}" for k in range(_WIDE))])
    tops = lambda name, deep: " UNION ALL ".join(f"SELECT grp, h FROM {name}{k} WHERE n = 1" for k in range(deep + 1))
    return f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf_sql("text")} AS h, {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS forged,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc32
  FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree_sql("s", "SELECT grp, idx, n, h FROM placed", _DEEP)},
subroots AS ({tops("s", _DEEP)}),
sources AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, h, grp AS source FROM subroots),
{_tree_sql("t", "SELECT grp, idx, n, h FROM sources", _WIDE)},
root AS ({tops("t", _WIDE)}),
d AS (SELECT p.*, q.idx AS place, q.h AS subroot, root.h AS root FROM placed p JOIN sources q ON q.source = p.grp, root),
x0 AS (SELECT d.doc_id, d.h AS leaf, d.subroot, d.root, CASE WHEN crc32 % {TAMPERED} = 0 THEN forged ELSE d.h END AS f, '' AS p, [{lr}] AS lr FROM d {" ".join(joins)}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM {before}
"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE_SQL = {"op11_merkle_manifest": _sql()}
