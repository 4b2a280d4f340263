"""Collections and chains written in steps, networks and names, quarantine, fingerprints, JSON lists, repeated events on a stream."""

import ipaddress
import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigilake.functions import names
from vigilake.operators import audit, collections_, design, normalize, replay
from vigilake.plans.flow import RUN_AT
from vigilake.sources import json_lists
from vigilake.sources.chains import ChainStore, ForkRefused
from vigilake.sources.keyed import BASE_EVERY, KeyedTable
from vigilake.streaming import alerts

WRITES = "key string, seq long, value string"


def kept(spark, path):
    return KeyedTable(spark, f"file://{path}", WRITES, "key", "seq", 4)


def state(df):
    return sorted(map(tuple, df.select("key", "seq", "value", "first_seq").collect()), key=repr)


def test_upserts_equal_one_write(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(20)}", i, f"v{i}") for i in range(200)] + [("k1", None, "none"), (None, 5, "lost")]
    table, batches = kept(spark, tmp_path), [rows[i::13] for i in range(13)]
    for batch_id, part in enumerate(batches):
        df = spark.createDataFrame(part, WRITES).withColumn("other", F.lit(1))
        table.upsert(df, batch_id)
        if batch_id % 4 == 3:  # the same batches again, in part beneath a base already
            before = state(table.read())
            for again in (batch_id - 1, batch_id):
                table.upsert(spark.createDataFrame(batches[again], WRITES), again)
            assert state(table.read()) == before
    base, since = table.tables()
    assert base == f"base-{BASE_EVERY - 1:012d}" and len(since) == 13 - BASE_EVERY
    whole = collections_.last_written(spark.createDataFrame([r for r in rows if r[0] and r[1] is not None], WRITES), "key", "seq")
    assert state(table.read()) == state(whole)
    assert state(table.get("k7")) == [r for r in state(whole) if r[0] == "k7"] and table.get("nobody").collect() == []
    assert kept(spark, tmp_path / "none").read().collect() == []


def test_a_killed_batch_is_not_read(spark, tmp_path):
    table = kept(spark, tmp_path)
    table.upsert(spark.createDataFrame([("a", 1, "x")], WRITES), 0)
    table.upsert(spark.createDataFrame([("a", 2, "y")], WRITES), 1)
    (tmp_path / "batch-000000000001" / "_SUCCESS").unlink()  # as a job leaves it that dies while it writes
    assert state(table.read()) == [("a", 1, "x", 1)]
    table.upsert(spark.createDataFrame([("a", 2, "y")], WRITES), 1)
    assert state(table.read()) == [("a", 2, "y", 1)]


def test_a_stream_that_is_killed_goes_on(spark, tmp_path):
    """The sink fails after it has written a batch, so that the batch comes again after the restart."""
    rows = [("k%d" % (i % 7), i, f"v{i}") for i in range(60)]
    table = kept(spark, tmp_path / "table")
    for k in range(3):
        spark.createDataFrame(rows[k::3], WRITES).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(WRITES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def dies(df, batch_id):
        table.upsert(df, batch_id)
        if batch_id == 1:
            raise RuntimeError("killed")

    query = stream().writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    table.sink(stream(), str(tmp_path / "at"), availableNow=True).awaitTermination()
    assert state(table.read()) == state(collections_.last_written(spark.createDataFrame(rows, WRITES), "key", "seq"))


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    table = kept(spark, tmp_path)
    table.upsert(spark.range(5000).selectExpr("concat('k', id) AS key", "id AS seq", "'v' AS value"), 0)
    df = table.get("k77")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,k77)]" in plan
    assert [r.seq for r in df.collect()] == [77]
    assert len([p for p in (tmp_path / "batch-000000000000").glob("bucket=*")]) == 4


EVENTS = "chain_id string, seq long, actor string, event_type string, flow_id string, subject_ref string, payload string, recorded_at string"


def events(spark, rows):
    return spark.createDataFrame([(c, s, "ops", "t", None, None, json.dumps({"n": s}), RUN_AT) for c, s in rows], EVENTS)


def test_appends_equal_one_build(spark, tmp_path):
    store, rows = ChainStore(spark, f"file://{tmp_path}/chains"), [("A", s) for s in range(40)] + [("B", s) for s in range(5)] + [("C", 7)]
    assert store.version() == 0 and store.events() is None and store.heads().collect() == []
    for low, high in ((0, 3), (3, 20), (20, 99)):
        store.append(events(spark, [r for r in rows if low <= r[1] < high]))
    whole = audit.chained(events(spark, rows))
    assert sorted(map(tuple, store.events().select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert {r.chain_id: (r.anchored, r.events) for r in store.verified().collect()} == {"A": (True, 40), "B": (True, 5), "C": (True, 1)}
    assert store.version() == 3 and audit.forks(store.events()).collect() == []


def test_forks_are_refused(spark, tmp_path):
    store = ChainStore(spark, f"file://{tmp_path}/chains")
    store.append(events(spark, [("A", 1), ("A", 2)]))
    for late in ([("A", 2)], [("A", 0)], [("B", 1), ("A", 1)]):
        with pytest.raises(ForkRefused):
            store.append(events(spark, late))
    read = store.version()
    store.append(events(spark, [("A", 3)]), read)
    with pytest.raises(ForkRefused):  # another writer that has read the same version
        store.append(events(spark, [("A", 4)]), read)
    assert store.version() == 2 and store.events().count() == 3
    # two that have got as far as the version's file: one of them makes it
    from vigilake.sources.store import create_text

    assert [create_text(spark, f"file://{tmp_path}/one", x) for x in "ab"] == [True, False] and (tmp_path / "one").read_text() == "a"
    # a tail that was cut off is intact in itself, but does not end at the kept head
    folder = next(p for p in Path(tmp_path / "chains").glob("events-*") if spark.read.parquet(str(p)).where("seq = 3").count())
    spark.createDataFrame([], spark.read.parquet(str(folder)).schema).write.mode("overwrite").parquet(str(folder))
    assert [(r.intact, r.anchored) for r in store.verified().collect()] == [(True, False)]


def test_networks_agree_with_ipaddress(spark):
    rng = random.Random(3)
    v6 = lambda: ipaddress.IPv6Address(rng.choice([0, 0x20010DB8 << 96, 0xFFFF << 32]) + rng.getrandbits(rng.choice([8, 40, 64, 90])))
    v4 = lambda: ipaddress.IPv4Address(0x0A000000 + rng.getrandbits(rng.choice([4, 12, 24])))
    nets = [f"{rng.choice([v6, v4])()}" for _ in range(10)]
    for _ in range(120):
        a = rng.choice([v6, v4])()
        size = rng.randrange(0 if rng.random() < 0.1 else 3, a.max_prefixlen + 1)
        nets.append(f"{a.exploded.upper() if rng.random() < 0.5 else a}/{size}")
    nets += ["::/0", "1.2.3.4/33", "::1/129", "x/8", "", "10.0.0.0/", "::ffff:10.0.0.0/104"]
    targets = [str(rng.choice([v6, v4])()) for _ in range(200)] + [a.exploded for a in (v6(), v6())] + ["::", "::1", "::ffff:10.0.0.9", "[2001:db8::5]", "host", "", "1.2.3", "1::2::3", "12345::", "10.0.0.256"]

    def network(n):
        try:
            return ipaddress.ip_network(n, strict=False)
        except ValueError:
            return None

    def best(t):
        try:
            a = ipaddress.ip_address(t.strip("[]"))
        except ValueError:
            return None
        return max((n.prefixlen for n in map(network, nets) if n and n.version == a.version and a in n), default=None)

    got = design.longest_prefix(spark.createDataFrame([(t,) for t in [*targets, None]], "target string"), spark.createDataFrame([(n,) for n in nets], "net string")).collect()
    assert {r.target: r.bits for r in got} == {t: best(t) for t in targets} | {None: None} and len(got) == len(targets) + 1
    assert all(r.net is None or network(r.net).prefixlen == r.bits for r in got)
    rules = spark.createDataFrame([("scope_allow", "cidr", n, False) for n in nets], "layer string, kind string, value string, include_apex boolean")
    verdicts = design.scope_verdict(spark.createDataFrame([(t,) for t in targets], "target string"), rules).collect()
    assert {r.target: r.verdict for r in verdicts} == {t: "deny" if best(t) is None else "allow" for t in targets}
    assert all(r.net is None for r in design.longest_prefix(spark.createDataFrame([("::1",)], "target string"), spark.createDataFrame([], "net string")).collect())


def test_international_names(spark):
    rng = random.Random(4)
    letters = "abcz09-äöüßéñçøåœłžčřşğıαβγωдежюшאבגעמלنمكやまとおかボタ中国网络한국어🎉𝒳"
    labels = ["bücher", "ü", "他们为什么不说中文", "3年b組金八先生", "a" * 50 + "ü", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(200))]
    labels = [x for x in labels if not x.isascii()]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", names.punycode(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == {x: x.encode("punycode").decode() for x in labels}
    whole = {"Bücher.Example.": "xn--bcher-kva.example", "日本語。JP": "xn--wgv71a119e.jp", "a.B": "a.b", "": "", "www.münchen.example": "www.xn--mnchen-3ya.example"}
    got = spark.createDataFrame([(x,) for x in [*whole, None]], "x string").select("x", names.host_name(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in got} == whole | {None: None}
    assert all(n == x.lower().replace("。", ".").rstrip(".").encode("idna").decode() for x, n in whole.items() if x)


def test_quarantine(spark):
    good = '{"event_type":"alert","src_ip":"1.1.1.1","alert":{"severity":1,"signature":"s"}}'
    eve = [good, "", '{"event_type":"flow","src_ip":null}', good[:-1], "[1]", '"text"', "null", '{"event_type":"alert","src_ip":null}', '{"event_type":"alert","alert":{"signature":null}}', '{"event_type":"alert","alert":{"severity":null}}', '{"event_type":"alert","alert":{"severity":"high"}}', '{"event_type":"alert","timestamp":null}', '{"event_type":"alert","dest_ip":null}', "\x00", "{}"]
    auth = ["Jul  6 21:10:15 web-01 sshd[1]: Failed password for root from 1.2.3.4 port 1", "Xyz  6 21:10:15 web-01 sshd[1]: Failed password for root from 1.2.3.4 port 1", "session opened", ""]
    rows = [("E1", 1, 0, "suricata_eve", i, x) for i, x in enumerate(eve)] + [("E2", 0, 0, "linux_auth", i, x) for i, x in enumerate(auth)] + [("E1", 1, 0, "suricata_eve", 99, None)]
    marked = normalize.with_reasons(spark.createDataFrame(rows, "evidence_id string, source_ord int, file_no int, source_type string, line_no int, line string"))
    got = {(r.evidence_id, r.line_no): r.reason for r in normalize.quarantined(marked).collect()}
    assert got == {("E1", 3): "not_json", ("E1", 4): "not_an_object", ("E1", 5): "not_an_object", ("E1", 6): "not_an_object", ("E1", 7): "null_value", ("E1", 8): "null_value", ("E1", 9): "null_value", ("E1", 10): "no_number", ("E1", 11): "null_value", ("E1", 13): "not_json", ("E1", 99): "not_json", ("E2", 1): "unknown_month"}
    found = normalize.parse_sound(marked)
    assert sorted((r.title, r.dedup_key) for r in found.collect())[0][0] == "Failed SSH password for root from 1.2.3.4" and found.count() == 3
    totals = {r.evidence_id: (r.lines, r.blank, r.alerts, r.left_out, r.quarantined) for r in normalize.line_totals(marked, found).collect()}
    assert totals == {"E1": (16, 1, 2, 2, 11), "E2": (4, 1, 1, 1, 1)}


def test_fingerprints(spark):
    rows = [(1, "a"), (2, None), (2, None), (None, "a")]
    df = spark.createDataFrame(rows, "k int, v string")
    same = spark.createDataFrame(rows[::-1], "k int, v string").select("v", "k").repartition(3)
    first = lambda x: tuple(replay.fingerprint(x).first())
    assert first(df) == first(same) and first(df)[0] == 4
    others = [rows[:3], [*rows, (2, None)], [(1, "a"), (2, None), (None, "a"), (None, "a")], [(1, None), (2, "a"), (2, None), (None, "a")], [(1, "a"), (2, ""), (2, None), (None, "a")]]
    assert len({first(spark.createDataFrame(x, "k int, v string")) for x in others} | {first(df)}) == 6
    assert first(spark.createDataFrame([], "k int")) == (0, 0, 0)

    class Side:
        def __init__(self, a, b):
            self.a, self.b = a, b

    got = {r.collection: (r.only_left, r.only_right, r.equal) for r in replay.compare(Side(df, df), Side(same, spark.createDataFrame(others[1], "k int, v string")), ("a", "b")).collect()}
    assert got == {"a": (0, 0, True), "b": (0, 1, False)}


def test_json_lists(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    new = spark.createDataFrame([("t1", 1, 1), ("t2", 2, 2), ("t2", 9, 3), (None, 4, 4)], "title string, n long, place int")
    files = lambda: {p.name: p.read_bytes() for p in (tmp_path / "list").glob("part-*")}
    assert json_lists.merge_list(spark, path, new, "title", "place") == 3
    once = files()
    assert json_lists.merge_list(spark, path, new, "title", "place") == 0 and files() == once
    every = [x for f in once.values() for x in json.loads(f)]
    assert sorted(map(str, every)) == sorted(map(str, [{"title": "t1", "n": 1}, {"title": "t2", "n": 2}, {"n": 4}]))
    more = spark.createDataFrame([("t2", 7, "x", 1), ("t3", 8, "y", 2)], "title string, n long, state string, place int")
    assert json_lists.merge_list(spark, path, more, "title", "place") == 1
    assert sorted(map(str, ((r.title, r.n, r.state) for r in json_lists.read_list(spark, path, "title string, n long, state string").collect()))) == sorted(map(str, [("t1", 1, None), ("t2", 2, None), (None, 4, None), ("t3", 8, "y")]))
    assert json_lists.merge_list(spark, path, new, "title", "place") == 0  # items keep what new ones do not have
    assert [p.name for p in tmp_path.iterdir()] == ["list"]
    (tmp_path / "one.json").write_text('[{"title": "a"},\n {"title": "b", "n": 2}]\n')
    assert json_lists.read_list(spark, f"file://{tmp_path}/one.json", "title string, n long").count() == 2
    (tmp_path / "bad.json").write_text('[{"title": "a"}, {"title": ')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        json_lists.read_list(spark, f"file://{tmp_path}/bad.json", "title string").collect()


def test_repeats_on_a_stream(spark, tmp_path):
    base = datetime(2026, 7, 6, 12)
    rows = [(base + timedelta(minutes=i), f"k{i % 3}", f"line {i % 20}") for i in range(60)]
    sent, schema = [rows[:30], rows[20:45] + rows[28:30], rows[40:] + rows[58:]], "ts timestamp, key string, line string"
    for k, part in enumerate(sent):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = alerts.without_repeats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["ts", "key", "line"], "30 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(rows)
