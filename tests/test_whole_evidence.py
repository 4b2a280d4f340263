"""Rows that name their evidence name all of it."""

from conftest import DATA

from vigilake.plans import catalogue


def test_incidents_name_all_their_evidence(spark):
    each = {}
    for r in catalogue.QUERIES["incident_evidence"](spark, DATA).collect():
        each.setdefault(r.incident_id, []).append(r.evidence_id)
    got = catalogue.QUERIES["incidents"](spark, DATA).collect()
    assert got and {r.incident_id: r.evidence_ids for r in got} == {k: ",".join(sorted(v)) for k, v in each.items()}
    assert all(r.evidence_count == len(r.evidence_ids.split(",")) for r in got)


def test_conflicts_name_all_their_evidence(spark):
    both = {}
    for r in catalogue.QUERIES["agent_disputes"](spark, DATA).collect():
        both.setdefault((r.task, r.common), []).append(r.evidence_id)
    got = catalogue.QUERIES["agent_conflicts"](spark, DATA).collect()
    found = {(r.task, common): names for r in got for common, names in ((True, r.common_evidence), (False, r.disputed_evidence)) if names}
    assert found == {k: ",".join(sorted(v)) for k, v in both.items()} and {c for _, c in found} == {True, False}
    assert all((r.n_common, r.n_disputed) == tuple(len(both.get((r.task, c), [])) for c in (True, False)) for r in got)
