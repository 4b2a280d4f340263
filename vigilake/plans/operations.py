"""Queries of running operations: stop conditions, stuck flows, collections and chains that are written in steps, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import audit, design, model_agent, normalize, replay, stops, triage
from vigilake.plans import sql as S
from vigilake.plans.flow import run_flow
from vigilake.sources import json_lists, raw
from vigilake.sources.chains import ChainStore
from vigilake.sources.keyed import KeyedTable
from vigilake.sources.store import fresh_path, save

QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _same_as(name: str):
    """A query whose result is that of another one, reached in steps; its twin is taken over by the catalogue."""

    def add(f):
        QUERIES[f.__name__], SAME[f.__name__] = f, name
        return f

    return add


SAME: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("""
WITH e AS (SELECT 'host-' || (user_id % 30) AS target, lpad(CAST(event_id AS VARCHAR), 10, '0') AS request_id, epoch_ms(ts) // 150 AS ms, event_id % 13 * 700 AS took, event_type = 'error' AND event_id % 8 = 0 AS error FROM events),
r AS (SELECT target, request_id, ms, 0 AS finish, 0 AS error FROM e UNION ALL SELECT target, request_id, ms + took, 1, CAST(error AS INTEGER) FROM e),
c AS (SELECT *, sum(1 - 2 * finish) OVER w AS open, sum(finish) OVER w AS done, sum(error) OVER w AS errors FROM r WINDOW w AS (PARTITION BY target ORDER BY ms, finish, request_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lag(ms, 2) OVER (PARTITION BY target ORDER BY ms, request_id) AS back FROM r WHERE finish = 0),
broken AS (
  SELECT target, 'concurrency' AS condition, ms, finish, request_id FROM c WHERE finish = 0 AND open > 3 UNION ALL SELECT target, 'error_rate', ms, finish, request_id FROM c WHERE finish = 1 AND errors > 0.02 * done
  UNION ALL SELECT target, 'rate', ms, finish, request_id FROM f WHERE ms - back < 1000)
SELECT target, condition, strftime(make_timestamp(min(ms) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS "at", arg_min(request_id, (ms, finish, request_id)) AS request_id FROM broken GROUP BY target, condition""")
def stop_conditions(spark, d):
    """Events as requests to thirty hosts, closer in time than they were; each takes up to eight seconds."""
    n = F.col("event_id")
    ms = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 150)
    rows = _table(spark, d, "events").select(F.concat(F.lit("host-"), (F.col("user_id") % 30).cast("string")).alias("target"), F.lpad(n.cast("string"), 10, "0").alias("request_id"), ms.alias("ms"), ((F.col("event_type") == "error") & (n % 8 == 0)).alias("error"), (n % 13 * 700).alias("took"))
    each = F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("ms").alias("ms")), F.struct(F.lit("finish").alias("kind"), (F.col("ms") + F.col("took")).alias("ms"))))
    log = rows.select("target", "request_id", "error", each.alias("x")).select("target", "request_id", "error", "x.kind", F.timestamp_millis("x.ms").alias("at"))
    return stops.stop_conditions(log).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"))


@_query("""
WITH c AS (SELECT o_custkey AS flow_id, CAST(o_orderdate AS TIMESTAMP) AS t, max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'waiting' END) AS status FROM orders GROUP BY ALL),
g AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY flow_id ORDER BY t), (SELECT max(t) FROM c)) - t AS quiet FROM c)
SELECT flow_id, status, strftime(t, '%Y-%m-%d') AS since, strftime(t + INTERVAL 90 DAYS, '%Y-%m-%d') AS noticed FROM g WHERE status <> 'completed' AND quiet > INTERVAL 90 DAYS""")
def stuck_flows(spark, d):
    """Customers as flows, whose orders are progress: none for ninety days after one that is not completed."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("waiting")
    changes = _table(spark, d, "orders").select(F.col("o_custkey").alias("flow_id"), F.col("o_orderdate").cast("timestamp").alias("at"), status.alias("status"))
    found = stops.stuck_flows(changes, 90 * 86_400_000, bucket_ms=365 * 86_400_000)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("since", "noticed")})


@_same_as("upsert_last_write")
def incremental_upsert(spark, d):
    """The orders as writes in four batches, of which one comes twice, with a base made after the second."""
    writes = _table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return written_in_batches(writes).read()


def written_in_batches(writes: DataFrame) -> KeyedTable:
    spark = writes.sparkSession
    kept = KeyedTable(spark, fresh_path(spark, "collection"), "key long, seq long, status string", "key", "seq", 4)
    for batch_id in (0, 1, 0, 2, 3):
        kept.upsert(writes.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == batch_id), batch_id)
        if batch_id == 1:
            kept.compact()
    return kept


LOOKED_UP = (1, 4, 7, 10, 1_000_000)


@_query(f"SELECT o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS first_seq FROM orders WHERE o_custkey IN {LOOKED_UP} GROUP BY o_custkey")
def pruned_lookup(spark, d):
    """The last orders of a few customers, each by its key from a collection that was written in batches."""
    writes = _table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    kept = written_in_batches(writes)
    found = [kept.get(key) for key in LOOKED_UP]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@_same_as("idempotent_merge")
def json_list_merge(spark, d):
    """Customers as a JSON list on disk, to which orders are added twice."""
    path = fresh_path(spark, "list")
    key = lambda c, origin, seq: (F.col(c).alias("key"), F.lit(origin).alias("origin"), F.col(seq).alias("seq"))
    json_lists.write_list(_table(spark, d, "customer").where("c_custkey % 3 = 0").select(*key("c_custkey", "old", "c_custkey")), path)
    new = _table(spark, d, "orders").select(*key("o_custkey", "new", "o_orderkey"), F.col("o_orderkey").alias("place"))
    json_lists.merge_list(spark, path, new, "key", "place")
    if json_lists.merge_list(spark, path, new, "key", "place"):
        raise AssertionError("a second merge has added items")
    return json_lists.read_list(spark, path, "key long, origin string, seq long")


_PRINT = lambda name, row, table: f"SELECT '{name}' AS collection, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS high, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS low FROM (SELECT sha256({row}) AS h FROM {table})"


@_query(_PRINT("orders", "'{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}'", "orders") + " UNION ALL " + _PRINT("lines", "'{\"flag\":\"' || l_returnflag || '\",\"key\":' || l_orderkey || ',\"none\":null}'", "lineitem"))
def collection_fingerprints(spark, d):
    """Fingerprints of two collections, one of them with repeated rows and a column of nulls."""
    orders = _table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"))
    lines = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("flag"), F.lit(None).cast("string").alias("none"))
    prints = [replay.fingerprint(df).select(F.lit(name).alias("collection"), "n", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low")) for name, df in (("orders", orders), ("lines", lines))]
    return prints[0].unionByName(prints[1])


def _damaged(spark, d) -> DataFrame:
    """The flow's raw lines, some of every file cut off, replaced by a list, or given a null or an unknown month."""
    evidence = run_flow(raw.event_sources(_table(spark, d, "events"))).evidence
    k, line, eve = F.col("line_no") % 50, F.col("line"), F.col("source_type") == "suricata_eve"
    hurt = F.when(eve & (k == 7), F.expr("left(line, length(line) - 2)")).when(eve & (k == 8), "[1]").when(eve & (k == 9), F.regexp_replace(line, '"src_ip":"[^"]*"', '"src_ip":null')).when(~eve & (k == 10), F.concat(F.lit("Xxx"), F.substr(line, F.lit(4)))).otherwise(line)
    return save(normalize.with_reasons(raw.source_lines(evidence).withColumn("line", hurt)), "lines")


_HURT = S.ALERTS + """,
hurt AS (
  SELECT p.*, e.event_type, CASE WHEN source_ord = 1 AND (line_no - 1) % 50 = 7 THEN 'not_json' WHEN source_ord = 1 AND (line_no - 1) % 50 = 8 THEN 'not_an_object' WHEN source_ord = 1 AND (line_no - 1) % 50 = 9 AND e.event_type <> 'view' THEN 'null_value' WHEN source_ord = 0 AND (line_no - 1) % 50 = 10 AND event_id % 11 <> 0 THEN 'unknown_month' END AS reason
  FROM placed p JOIN events e USING (event_id))"""


@_query(S.query(_HURT, """
SELECT evidence_id, CAST(line_no - 1 AS INTEGER) AS line_no, reason, sha256(CASE reason WHEN 'not_json' THEN substr(line, 1, length(line) - 2) WHEN 'not_an_object' THEN '[1]' WHEN 'null_value' THEN regexp_replace(line, '"src_ip":"[^"]*"', '"src_ip":null') ELSE 'Xxx' || substr(line, 4) END) AS line_hash
FROM hurt WHERE reason IS NOT NULL"""))
def quarantined_lines(spark, d):
    return normalize.quarantined(_damaged(spark, d)).select("evidence_id", "line_no", "reason", F.sha2("line", 256).alias("line_hash"))


@_query(S.query(_HURT, """
SELECT evidence_id, count(*) AS lines, CAST(0 AS BIGINT) AS blank, count(*) FILTER (WHERE good) AS alerts, count(reason) AS quarantined, count(*) FILTER (WHERE NOT good AND reason IS NULL) AS left_out
FROM (SELECT *, reason IS NULL AND CASE WHEN source_ord = 0 THEN event_id % 11 <> 0 ELSE event_type <> 'view' END AS good FROM hurt) GROUP BY evidence_id"""))
def line_totals(spark, d):
    marked = _damaged(spark, d)
    return normalize.line_totals(marked, normalize.parse_sound(marked))


@_query("""
WITH s AS (SELECT s_suppkey AS n, s_suppkey % 16 AS k FROM supplier),
six AS (SELECT '2001:db8:' || printf('%x', k) || '::' || printf('%x', n) AS target, CASE WHEN n % 10 = 0 THEN '2001:DB8:' || printf('%x', k) || ':0::' || printf('%x', n) || '/124' WHEN k % 2 = 0 THEN '2001:db8:' || printf('%x', k) || '::/48' ELSE '2001:db8::/32' END AS net, CASE WHEN n % 10 = 0 THEN 124 WHEN k % 2 = 0 THEN 48 ELSE 32 END AS bits FROM s),
four AS (SELECT '10.' || (n % 4) || '.' || (n // 4 % 256) || '.' || (n % 256) AS target, CASE WHEN n % 4 = 1 THEN '10.1.0.0/16' WHEN n % 4 = 2 AND n // 4 % 256 < 128 THEN '10.2.0.0/17' ELSE '10.0.0.0/8' END AS net, CASE WHEN n % 4 = 1 THEN 16 WHEN n % 4 = 2 AND n // 4 % 256 < 128 THEN 17 ELSE 8 END AS bits FROM s)
SELECT * FROM six UNION ALL SELECT * FROM four UNION ALL SELECT 'host-' || n, NULL, NULL FROM s""")
def network_lookup(spark, d):
    """Suppliers' addresses of both kinds, and names, in networks of which some hold others."""
    n, k = F.col("s_suppkey"), F.col("s_suppkey") % 16
    low = lambda x: F.lower(F.hex(x))
    suppliers = _table(spark, d, "supplier")
    six = suppliers.select(F.concat(F.lit("2001:db8:"), low(k), F.lit("::"), low(n)).alias("target"))
    four = suppliers.select(F.concat(F.lit("10."), (n % 4).cast("string"), F.lit("."), (F.floor(n / 4) % 256).cast("string"), F.lit("."), (n % 256).cast("string")).alias("target"))
    names = suppliers.select(F.concat(F.lit("host-"), n.cast("string")).alias("target"))
    small = suppliers.where(n % 10 == 0).select(F.concat(F.lit("2001:DB8:"), low(k), F.lit(":0::"), low(n), F.lit("/124")).alias("net"))
    fixed = ["2001:db8::/32", *(f"2001:db8:{i:x}::/48" for i in range(0, 16, 2)), "10.0.0.0/8", "10.1.0.0/16", "10.2.0.0/17", "2001:db8::/129", "10.0.0.0/33", "nowhere/8"]
    nets = small.unionByName(spark.createDataFrame([(x,) for x in fixed], "net string"))
    return design.longest_prefix(six.unionByName(four).unionByName(names), nets).select("target", "net", "bits")


@_query("""
WITH t AS (SELECT s_suppkey AS n, CASE s_suppkey % 7 WHEN 0 THEN 'S' || s_suppkey || '.Bücher.Example.' WHEN 1 THEN 's' || s_suppkey || '.xn--bcher-kva.example' WHEN 2 THEN 'münchen.example' WHEN 3 THEN 'a' || s_suppkey || '。日本語。jp' WHEN 4 THEN '2001:db8:3::' || printf('%x', s_suppkey) WHEN 5 THEN '[2001:DB8:4::' || printf('%x', s_suppkey) || ']' ELSE '::ffff:10.1.2.' || (s_suppkey % 256) END AS target FROM supplier)
SELECT n, target, CASE n % 7 WHEN 0 THEN 'scope_allow' WHEN 1 THEN 'scope_allow' WHEN 2 THEN 'scope_deny' WHEN 3 THEN 'scope_allow' WHEN 4 THEN 'tenant_deny' WHEN 5 THEN 'scope_allow' ELSE CASE WHEN n % 256 >= 128 THEN 'scope_allow' END END AS layer,
  CASE WHEN n % 7 IN (0, 1, 3, 5) OR (n % 7 = 6 AND n % 256 >= 128) THEN 'allow' ELSE 'deny' END AS verdict FROM t""")
def international_targets(spark, d):
    """International names against rules in either form, and IPv6 addresses against networks."""
    n = F.col("s_suppkey")
    s, x = n.cast("string"), F.lower(F.hex(n))
    kinds = (F.concat(F.lit("S"), s, F.lit(".Bücher.Example.")), F.concat(F.lit("s"), s, F.lit(".xn--bcher-kva.example")), F.lit("münchen.example"), F.concat(F.lit("a"), s, F.lit("。日本語。jp")), F.concat(F.lit("2001:db8:3::"), x), F.concat(F.lit("[2001:DB8:4::"), x, F.lit("]")))
    target = F.concat(F.lit("::ffff:10.1.2."), (n % 256).cast("string"))
    for k, value in enumerate(kinds):
        target = F.when(n % 7 == k, value).otherwise(target)
    rules = [("scope_allow", "domain", "xn--bcher-kva.EXAMPLE", False), ("scope_allow", "host", "xn--mnchen-3ya.example", False), ("scope_deny", "host", "MÜNCHEN.example.", False), ("scope_allow", "domain", "日本語.jp", False), ("tenant_deny", "cidr", "2001:db8:3::/48", False), ("scope_allow", "cidr", "2001:db8::/32", False), ("scope_allow", "cidr", "::ffff:10.1.2.128/121", False)]
    found = design.scope_verdict(_table(spark, d, "supplier").select(n.alias("n"), target.alias("target")), spark.createDataFrame(rules, "layer string, kind string, value string, include_apex boolean"))
    return found.select("n", "target", "layer", "verdict")


def chain_events(spark, d) -> DataFrame:
    from vigilake.operators import policy, workflow
    from vigilake.plans import catalogue, flow

    done = catalogue._outcomes(spark, d)
    flows = flow.flow_states(done).select("flow_id", "status", F.lit("soc_investigation").alias("flow_type"), F.concat(F.lit("Investigation of "), "flow_id").alias("title"))
    return workflow.events(workflow.records(done), flows, policy.ACTOR, flow.RUN_AT)


def _appended(spark, d) -> ChainStore:
    """The events of the flows in three appends: those of each flow's first groups, those of the others, and the last ones."""
    events = save(chain_events(spark, d), "events")
    kept = ChainStore(spark, fresh_path(spark, "chains"))
    place = F.when(F.col("seq") > 2**60, 2).when(F.floor(F.col("seq") / 100) % 50 > 20, 1).when((F.floor(F.col("seq") / 100) % 50 == 0) & (F.col("seq") > 100), 1).otherwise(0)
    for k in range(3):
        kept.append(events.where(place == k))
    return kept


@_same_as("audit_chain_build")
def audit_chain_appended(spark, d):
    return _appended(spark, d).events().select("chain_id", "event_id", "event_type", "actor", "prev_hash", "entry_hash")


@_same_as("audit_chain_verify")
def audit_chain_anchored(spark, d):
    return _appended(spark, d).verified().select("chain_id", F.col("anchored").alias("intact"), "events", "head")


@_query("""
SELECT 'C-' || o_custkey AS chain_id, CAST(2 AS BIGINT) AS branches FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey HAVING count(*) > 1""")
def chain_forks(spark, d):
    """Customers' orders as chains; of every fifth customer a second writer has gone on from the first event as well."""
    seq, none = F.col("o_orderkey"), F.lit(None).cast("string")
    events = _table(spark, d, "orders").select(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("chain_id"), seq.alias("seq"), F.lit("ops").alias("actor"), F.col("o_orderstatus").alias("event_type"), none.alias("flow_id"), none.alias("subject_ref"), F.lit("{}").alias("payload"), F.col("o_orderdate").cast("string").alias("recorded_at"))
    first = events.groupBy("chain_id").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    marked = events.join(first, "chain_id")
    chain = audit.chained(events)
    begun = chain.join(first.select("chain_id", F.col("first").alias("seq")), ["chain_id", "seq"], "left_semi")
    other = marked.where((F.expr("cast(substring(chain_id, 3) as bigint)") % 5 == 0) & (F.col("seq") > F.col("first"))).withColumn("actor", F.lit("other"))
    second = audit.chained(other.select(events.columns), audit.heads(begun))
    return audit.forks(chain.unionByName(second)).select("chain_id", "branches")


def model_triage(spark, d):
    """A model fitted to the rule agent's decisions on a bounded sample, applied to all groups: how its dispositions agree with the rules'.

    No twin: a fitted model; tests hold it against a plain gradient descent.
    """
    decided = run_flow(raw.event_sources(_table(spark, d, "events"))).triaged
    registry = model_agent.Registry(triage.resolve("soc.triage"), model_agent.fit_agent(decided, "1"))
    rules = decided.select("group_id", F.col("disposition").alias("expected"))
    groups = decided.drop("disposition", "confidence", "rationale", "recommended_action_types", "attack_techniques", "agent_run_id")
    found = triage.triage(groups, registry.resolve("soc.model", "1"))
    return found.join(rules, "group_id").groupBy("expected", F.col("disposition").alias("predicted"), "risk_band").agg(F.count("*").alias("groups"), F.round(F.avg("confidence"), 3).alias("confidence"))


QUERIES["model_triage"] = model_triage
