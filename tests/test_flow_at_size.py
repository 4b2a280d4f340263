"""What keeps the flow in proportion to its input: files are numbered without their data, each line is parsed once, and tasks share both."""

import re

import pyarrow.parquet as pq
from conftest import DATA
from pyspark.sql import functions as F

from vigilake.operators import normalize
from vigilake.plans import assurance, catalogue
from vigilake.plans.flow import run_flow
from vigilake.sources import raw

READ = raw.read_sources


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sources(spark, files: int, copies: int = 1):
    line = F.concat(F.lit("Jul  6 21:10:15 web-01 sshd[11]: Failed password for root from 198.51.100."), (F.col("id") % 7).cast("string"), F.lit(" port 51 ssh2"))
    return spark.range(files).select(F.concat(F.lit("a-"), F.col("id").cast("string")).alias("name"), F.lit("linux_auth").alias("source_type"), F.lit("text/plain").alias("media_type"), F.lit(0).alias("source_ord"), F.floor(F.col("id") / copies).alias("file_no"), F.encode(line, "UTF-8").alias("data"))


def test_the_data_of_files_is_not_sorted_to_number_them(spark):
    assert "Window" not in _plan(raw.with_evidence(_sources(spark, 20), "x"))


def test_alerts_are_numbered_from_a_table_of_parsed_lines(spark):
    plan = _plan(normalize.parse(raw.source_lines(raw.with_evidence(_sources(spark, 20), "x"))))
    assert "Window" in plan and "regexp_extract" not in plan.lower() and "rlike" not in plan.lower()


def test_alerts_of_one_type_are_numbered_by_many_tasks(spark):
    parsed = normalize.parse(raw.source_lines(run_flow(_sources(spark, 500)).evidence))
    got = parsed.select("seq", "alert_id").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 501)) and got[-1].alert_id == "ALERT-0500"
    assert normalize.FILES_NUMBERED < 500


def test_files_of_one_number_keep_their_own_rows(spark):
    got = raw.with_evidence(_sources(spark, 30, copies=3), "x").collect()
    assert sorted(r.evidence_no for r in got) == list(range(1, 31)) and len({r.name for r in got}) == 30
    assert all(int(r.name[2:]) // 3 == (r.evidence_no - 1) // 3 for r in got)


def test_a_report_and_its_chains_come_of_one_run(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(catalogue, "run_flow", lambda sources: runs.append(1) or run_flow(sources))
    monkeypatch.setattr(catalogue.audit, "chain_state", lambda chains: chains)
    monkeypatch.setattr(catalogue, "flow_report", lambda flow, chains: flow)
    monkeypatch.setattr(catalogue, "invariants", lambda flow, chains: flow)
    catalogue.run_report(spark, DATA)
    catalogue.invariant_checks(spark, DATA)
    assert len(runs) == 2


def test_source_files_are_many_and_small(spark, monkeypatch):
    read = []
    monkeypatch.setattr(assurance.raw, "read_sources", lambda s, path, *kind: read.append(spark.read.format("binaryFile").load(path).count()) or READ(s, path, *kind))
    monkeypatch.setattr(assurance, "SOURCES_PER_FILE", 1)
    with_files = assurance.source_files(spark, DATA.replace("sf0.001", "sf0.01"))
    assert read == [10, 10] and sorted(r.source for r in with_files.collect()) == ["linux_auth", "suricata_eve"]


def test_a_replay_is_dealt_by_no_fixed_number(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(catalogue, "run_flow", lambda sources: runs.append(sources) or run_flow(sources))
    monkeypatch.setattr(catalogue.replay, "compare", lambda a, b, collections: None)
    catalogue.replay_diff(spark, DATA)
    plan = _plan(runs[1])
    assert re.search(r"RepartitionByExpression \[name#\d+\]", plan) and not re.search(r"RepartitionByExpression \[name#\d+\], \d", plan)


def test_two_runs_are_compared_over_files_rendered_once(spark, monkeypatch):
    made, render = [], raw.event_sources
    monkeypatch.setattr(catalogue.raw, "event_sources", lambda events: made.append(1) or render(events))
    assert [tuple(r) for r in catalogue.run_comparison(spark, DATA).select("collection").collect()] == [("alert_groups",)]
    assert len(made) == 1


def _lines(spark, rows):
    return spark.createDataFrame([("E1", 1, 0, kind, k, line) for k, (kind, line) in enumerate(rows)], "evidence_id string, source_ord int, file_no int, source_type string, line_no int, line string")


def test_each_line_is_parsed_once(spark):
    assert _plan(normalize.eve_alerts(_lines(spark, [("suricata_eve", "{}")]).repartition(2))).count("parseJson") == 1
    auth = _plan(normalize.auth_alerts(_lines(spark, [("linux_auth", "x")]).repartition(2)))
    assert auth.count("Failed password for (") == 2  # whether it is a failed login, and its parts


def test_each_type_of_event_is_looked_up_once_to_find_reasons(spark):
    assert _plan(normalize.with_reasons(_lines(spark, [("suricata_eve", "{}")]).repartition(2))).count("$.event_type") == 1


def test_rare_line_ends_are_found_in_texts_that_have_one(spark):
    texts = ["", "a", "a\nb", "a\nb\n", "\n\n", "a\r\nb\nc", "a\rb\r\n\r\n", *(f"a{end}b\nc{end}" for end in "\u000b\u000c\u001c\u001d\u001e\u0085  "), "ä \r\nß", "‧a\u0084"]
    rows = spark.createDataFrame([(f"E{k:02d}", 0, k, "linux_auth", bytearray(t.encode())) for k, t in enumerate(texts)], "evidence_id string, source_ord int, file_no int, source_type string, data binary")
    assert "contains" in _plan(raw.source_lines(rows.repartition(2))).lower()  # others are split without a pattern
    got = {}
    for r in sorted(raw.source_lines(rows).collect(), key=lambda r: (r.evidence_id, r.line_no)):
        got.setdefault(r.evidence_id, []).append(r.line)
    assert got == {f"E{k:02d}": t.splitlines() for k, t in enumerate(texts) if t}


def test_parts_of_a_login_are_as_they_stand(spark):
    line = "Jul  6 21:10:15 wéb-01$1 sshd[11]: Failed password for a\\b$2 from 198.51.100.7 port 51\tssh2 é"
    (got,) = normalize.auth_alerts(_lines(spark, [("linux_auth", line), ("linux_auth", "Jul 6 1 a sshd b c")])).collect()
    assert (got.host, got.title, got.event_time) == ("wéb-01$1", "Failed SSH password for a\\b$2 from 198.51.100.7", "2026-07-06T21:10:15Z")


def test_raw_sources_are_read_a_few_at_a_time(spark):
    files = _sources(spark, 60).coalesce(1).withColumn("data", F.encode(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: F.sha2(F.concat("name", x.cast("string")), 256)), "\n"), "UTF-8"))
    parts = [p.removeprefix("file://") for p in raw.with_evidence(files, "x").inputFiles() if "/sources-" in p]
    metas = [pq.ParquetFile(p).metadata for p in parts]
    rows = [m.row_group(k).num_rows for m in metas for k in range(m.num_row_groups)]
    assert sum(rows) == 60 and max(rows) <= 20
