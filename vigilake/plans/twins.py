"""The SQL twin of every query in the catalogue, for DuckDB over the same tables."""

from __future__ import annotations

from vigilake.functions.knowledge import NO_CREDENTIALS, PLACEHOLDERS, SECRET_PATTERNS
from vigilake.operators.audit import GENESIS
from vigilake.operators.grouping import LISTED
from vigilake.plans import sql as S
from vigilake.plans.flow import COLLECTIONS, RUN_AT

_q = S.query

# scopes as in the catalogue, with their canonical JSON
_SCOPES = """
scopes(scope_id, scope_version, approved, autonomy_level, actors, targets, valid_from, valid_until) AS (VALUES
  ('S-OK', 1, true, 3, ['ops'], ['web-01', '*.example.internal'], '2026-07-01T00:00:00Z', '2026-12-31T00:00:00Z'), ('S-HIGH', 2, true, 4, ['ops', 'bot'], ['web-01', 'host-2'], NULL, ''), ('S-DRAFT', 1, false, 5, ['ops'], ['web-01'], NULL, NULL), ('S-NULL', 1, NULL, 5, ['ops'], ['web-01'], NULL, NULL),
  ('S-UNBOUND', 1, true, 5, ['ops'], ['web-01'], NULL, NULL), ('S-OLD', 3, true, 5, ['ops'], ['web-01'], '', '2026-07-01T00:00:00Z'), ('S-NOBODY', 1, true, 5, CAST([] AS VARCHAR[]), ['web-01'], NULL, NULL), ('S-NOWHERE', 1, true, 5, ['ops'], CAST([] AS VARCHAR[]), NULL, NULL))"""
_list = lambda c: f"""'[' || array_to_string(list_transform(list_sort({c}), lambda x: '"' || x || '"'), ',') || ']'"""
_text = lambda c: f"""coalesce('"' || {c} || '"', 'null')"""
_CANONICAL = f"""'{{"allowed_actors":' || {_list("actors")} || ',"autonomy_level":' || autonomy_level || ',"scope_version":' || scope_version || ',"target_allowlist":' || {_list("targets")} || ',"valid_from":' || {_text("valid_from")} || ',"valid_until":' || {_text("valid_until")} || '}}'"""

_NOTES = """
notes AS (
  SELECT 'part-' || p_partkey AS location, 'note of part ' || p_partkey || chr(10) ||
    CASE p_partkey % 9 WHEN 0 THEN 'password = "s3cr3t' || p_partkey || 'xyz"' WHEN 1 THEN 'api_key: required' WHEN 2 THEN 'mail bob' || p_partkey || '@corp.example.org now' WHEN 3 THEN 'host 10.1.2.3 and 192.168.0.7, 172.16.9.9 too'
      WHEN 4 THEN 'AKIA' || lpad(CAST(p_partkey AS VARCHAR), 16, 'A') WHEN 5 THEN 'see placeholder token secret=abcdefghij' WHEN 6 THEN 'ghp_' || lpad(CAST(p_partkey AS VARCHAR), 24, 'x') WHEN 7 THEN '/Users/jane/work C:\\Users\\jane\\work' ELSE 'nothing here' END
    || chr(10) || '"uploaded_by" : "user ' || p_partkey || '" at /srv/home/work/x' AS text FROM part),
texts AS (SELECT location, text FROM notes UNION ALL SELECT 'doc-' || doc_id, text FROM documents),
split AS (SELECT location, parts, unnest(generate_series(1, len(parts))) AS line FROM (SELECT location, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS parts FROM texts)),
numbered_lines AS (SELECT location, line, parts[line] AS s FROM split WHERE NOT (line = len(parts) AND parts[line] = ''))""".replace("\\\\", "\\")


def _patterns() -> str:
    """Each pattern over column s; the look-ahead of the e-mail rule, which RE2 lacks, as a filter on what it found."""
    out = []
    for severity, rule, pattern in SECRET_PATTERNS:
        source = S.text(pattern.replace(r"(?!example\.com\b)", ""))
        hits = f"regexp_extract_all(s, {source})"
        if rule == "email-address":
            hits = rf"list_filter({hits}, lambda m: NOT regexp_matches(m, '@example\.com\b'))"
        if rule == "credential-assignment":
            value = rf"""lower(regexp_replace(regexp_replace(m, '^[^:=]*[:=]\s*["'']?', ''), '["'']$', ''))"""
            hits = f"list_filter({hits}, lambda m: {value} NOT IN ({', '.join(map(S.text, NO_CREDENTIALS))}))"
        out.append(f"SELECT '{severity}' AS severity, '{rule}' AS rule, location, line, substr(unnest({hits}), 1, 160) AS \"match\" FROM chosen")
    return " UNION ALL ".join(out)


def _scan(skip: bool, select: str) -> str:
    where = " AND ".join(f"NOT contains(lower(s), {S.text(p)})" for p in PLACEHOLDERS) if skip else "true"
    return f"WITH {_NOTES.lstrip()},\nchosen AS (SELECT * FROM numbered_lines WHERE {where}),\nfound AS ({_patterns()})\n{select}"


_ip = lambda x: f"(CASE WHEN regexp_matches({x}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT) END)"

# the junk score: steps of features, their weights from the labels that train, and the sum of weights for the others
_FIT = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws, quality = 0 AS e FROM documents JOIN labels USING (doc_id)),
x AS (SELECT doc_id, e, coalesce(CAST(floor(length(regexp_replace(t, '[^a-zA-Z ]', '', 'g')) * 20 / nullif(length(t), 0)) AS INTEGER), -1) AS letters, least(coalesce(CAST(floor(length(array_to_string(ws, '')) / nullif(len(ws), 0)) AS INTEGER), -1), 15) AS word_length, coalesce(CAST(floor(len(list_distinct(ws)) * 20 / nullif(len(ws), 0)) AS INTEGER), -1) AS new_words FROM t),
a AS (SELECT count(*) FILTER (WHERE e) AS y, count(*) FILTER (WHERE NOT e) AS n FROM x WHERE doc_id % 5 <> 0),
s AS (SELECT feature, step, count(*) FILTER (WHERE e) AS y, count(*) FILTER (WHERE NOT e) AS n FROM (SELECT e, z.f AS feature, z.s AS step FROM (SELECT e, unnest([{'f': 'letters', 's': letters}, {'f': 'word_length', 's': word_length}, {'f': 'new_words', 's': new_words}]) AS z FROM x WHERE doc_id % 5 <> 0)) GROUP BY ALL),
w AS (SELECT feature, step, round(ln((s.y + 1) / (s.n + 1)) - ln((a.y + 1) / (a.n + 1)), 6) AS weight FROM s, a),
l AS (SELECT x.e, round((SELECT round(ln((y + 1) / (n + 1)), 6) FROM a) + coalesce(w1.weight, 0) + coalesce(w2.weight, 0) + coalesce(w3.weight, 0), 6) > 0 AS p FROM x LEFT JOIN w w1 ON w1.feature = 'letters' AND w1.step = letters LEFT JOIN w w2 ON w2.feature = 'word_length' AND w2.step = word_length LEFT JOIN w w3 ON w3.feature = 'new_words' AND w3.step = new_words WHERE doc_id % 5 = 0)"""

ORACLE_SQL = {
    "parse_auth_lines": _q(S.ALERTS, "SELECT title, asset_id, event_time, dedup_key, severity, evidence_id AS evidence_ids FROM auth"),
    "parse_eve_lines": _q(S.ALERTS, "SELECT title, asset_id, event_time, dedup_key, severity, evidence_id AS evidence_ids FROM eve"),
    "alert_ids_numbered": _q(S.ALERTS, "SELECT printf('ALERT-%04d', seq) AS alert_id, source, dedup_key, event_time FROM alerts"),
    "alert_groups_scored": _q(S.GROUPS, f"SELECT dedup_key, signature, asset_id, severity, count, CASE WHEN count <= {LISTED} THEN alert_ids END AS alert_ids, CASE WHEN count <= {LISTED} THEN evidence_ids END AS evidence_ids, first_seen, last_seen, risk_score, risk_band FROM groups"),
    "alert_group_members": _q(S.ALERTS, "SELECT dedup_key, row_number() OVER (PARTITION BY dedup_key ORDER BY seq) AS place, printf('ALERT-%04d', seq) AS alert_id FROM alerts"),
    "group_evidence": _q(S.GROUPS, "SELECT DISTINCT group_id, evidence_id FROM alerts JOIN groups USING (dedup_key)"),
    "incident_evidence": _q(S.INCIDENTS, "SELECT DISTINCT incident_id, evidence_id FROM alerts JOIN incidents USING (dedup_key)"),
    "group_first_appearance": _q(S.GROUPS, "SELECT group_id, dedup_key FROM groups"),
    "triage_dispositions": _q(S.TRIAGED, "SELECT group_id, disposition, confidence, rationale, attack_techniques, actions FROM triaged"),
    "agent_runs": _q(S.TRIAGED, f"""SELECT agent_run_id, 'soc.triage' AS agent_name, '0.2.0' AS agent_version, group_id AS input_refs,
  '{{"attack_techniques":["' || attack_techniques || '"],"disposition":"' || disposition || '","recommended_action_types":[' || CASE WHEN actions = '' THEN '' ELSE '"' || actions || '"' END || ']}}' AS output, confidence, 'ok' AS status, '{RUN_AT}' AS started_at FROM triaged"""),
    "escalation_gate": _q(S.TRIAGED, "SELECT disposition, evidence_ids <> '' AND confidence >= 0.5 AS passes, count(*) AS groups FROM triaged GROUP BY ALL"),
    "incidents": _q(S.INCIDENTS, f"SELECT incident_id, title, severity, 'open' AS status, asset_id, group_id AS alert_group_ids, evidence_ids, len(string_split(evidence_ids, ',')) AS evidence_count, agent_run_id AS triage_ref, attack_techniques, '{RUN_AT}' AS created_at FROM incidents"),
    "control_mappings": _q(S.PLANS, "SELECT mapping_id, incident_id, control_id, CAST(0.8 AS DOUBLE) AS confidence, 'Incident evidences control ' || control_id || ' (' || control_title || ').' AS rationale FROM mappings"),
    "risk_register": _q(S.INCIDENTS, """SELECT printf('RISK-%04d', incident_no) AS risk_id, 'Exposure from ' || title AS title, 'Observed activity (' || CASE WHEN attack_techniques = '' THEN 'n/a' ELSE attack_techniques END || ') on ' || asset_id || ' could lead to compromise if unaddressed.' AS statement,
  'medium' AS likelihood, severity AS impact, CASE severity WHEN 'info' THEN 'informational' ELSE severity END AS inherent_band, 'open' AS treatment_status, incident_id AS related_incident_id FROM incidents"""),
    "action_plans": _q(S.PLANS, """SELECT action_plan_id, plan_title AS title, action_type, risk_level, 'proposed' AS status, '{"asset_id":"' || asset_id || '"}' AS target, parameters, rollback, true AS requires_approval, incident_id AS created_from FROM plans"""),
    "policy_decisions": _q(S.DECISIONS, f"SELECT request_id AS request_ref, 'deny' AS effect, reason_code, message, '{RUN_AT}' AS evaluated_at, action_plan_id FROM decisions JOIN messages USING (reason_code)"),
    "policy_gates": f"""WITH {_SCOPES.lstrip()},
bound AS (SELECT *, CASE WHEN scope_id = 'S-UNBOUND' THEN '' ELSE 'x' END AS hash FROM scopes),
requests AS (
  SELECT 'R' || o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN 'bot' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'ops' END AS actor, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_level,
    CASE o_orderkey % 7 WHEN 0 THEN 'a.example.internal' WHEN 1 THEN 'evil-example.internal' WHEN 2 THEN 'host-2' WHEN 3 THEN 'example.internal' ELSE 'web-01' END AS target, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS has_approval,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN '2026-06-30T00:00:00Z' ELSE '2026-07-06T21:15:00Z' END AS moment FROM orders),
decided AS (
  SELECT *, CASE WHEN NOT coalesce(approved, false) THEN 'SCOPE_NOT_APPROVED' WHEN hash = '' THEN 'SCOPE_UNBOUND' WHEN moment IS NULL OR (coalesce(valid_from, '') <> '' AND moment < valid_from) THEN 'SCOPE_WINDOW_INVALID' WHEN coalesce(valid_until, '') <> '' AND moment > valid_until THEN 'SCOPE_EXPIRED'
    WHEN NOT coalesce(list_contains(actors, actor), false) THEN 'ACTOR_NOT_PERMITTED' WHEN NOT (list_contains(targets, target) OR (list_contains(targets, '*.example.internal') AND ends_with(target, '.example.internal'))) THEN 'TARGET_NOT_IN_SCOPE'
    WHEN risk_level <> 'low' AND NOT coalesce(has_approval, false) THEN 'APPROVAL_REQUIRED' WHEN autonomy_level < CASE WHEN risk_level = 'low' AND NOT coalesce(has_approval, false) THEN 4 ELSE 3 END THEN 'AUTONOMY_LEVEL_INSUFFICIENT' ELSE 'ALLOW_OK' END AS reason_code
  FROM requests, bound),
messages(reason_code, message) AS (VALUES {", ".join(f"({S.text(k)}, {S.text(v)})" for k, v in S.K.POLICY_MESSAGES.items())})
SELECT scope_id, reason_code, CASE WHEN reason_code = 'ALLOW_OK' THEN 'allow' ELSE 'deny' END AS effect, message, count(*) AS n, min(request_id) AS first_request FROM decided JOIN messages USING (reason_code) GROUP BY ALL""",
    "target_allowlist": """WITH t AS (SELECT s_suppkey, lower(replace(s_name, '#', '-')) || CASE s_nationkey % 3 WHEN 0 THEN '.example.internal' WHEN 1 THEN 'example.internal' ELSE '' END AS target FROM supplier)
SELECT s_suppkey, target, target = 'supplier-000000001' OR target = '*' OR target = '*.example.internal' OR (ends_with(target, '.example.internal') AND target <> 'example.internal') AS allowed FROM t""",
    "scope_policy_hash": f"""
WITH scopes AS (
  SELECT 'S-' || o_orderkey AS scope_id, o_orderkey % 4 + 1 AS scope_version, o_orderkey % 5 AS autonomy_level, CASE WHEN o_orderkey % 7 = 0 THEN CAST([] AS VARCHAR[]) WHEN o_orderkey % 3 = 0 THEN ['ops', 'c' || o_custkey] ELSE ['c' || o_custkey] END AS actors, CASE WHEN o_orderkey % 5 = 0 THEN ['web-01'] ELSE ['web-01', '*.d' || (o_orderkey % 11) || '.example'] END AS targets,
    CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderdate AS DATE) || 'T00:00:00Z' END AS valid_from, CASE WHEN o_orderkey % 4 > 0 THEN (CAST(o_orderdate AS DATE) + 90) || 'T00:00:00Z' END AS valid_until FROM orders)
SELECT scope_id, 'sha256:' || sha256({_CANONICAL}) AS policy_hash FROM scopes""",
    "flow_outcomes": _q(S.OUTCOMES, "SELECT flow_id, group_id, signature, risk_score, risk_band, disposition, incident_id, control_id, printf('RISK-%04d', incident_no) AS risk_id, CASE impact WHEN 'info' THEN 'informational' ELSE impact END AS inherent_band, action_plan_id, effect, reason_code FROM outcomes"),
    "flow_summary": _q(S.PLANS, "SELECT *, round(alerts / groups, 6) AS alerts_per_group FROM (SELECT (SELECT count(*) FROM evidence) AS evidence, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM incidents) AS incidents, (SELECT count(*) FROM plans) AS plans)"),
    "inbox_by_disposition": _q(S.TRIAGED, "SELECT disposition, risk_band, CASE WHEN disposition = 'escalate' AND confidence >= 0.8 THEN 'P0' WHEN disposition = 'escalate' THEN 'P1' WHEN disposition = 'monitor' THEN 'P2' ELSE 'P3' END AS priority, count(*) AS groups, CAST(sum(count) AS BIGINT) AS alerts, max(risk_score) AS top_score FROM triaged GROUP BY ALL"),
    "queue_top": _q(S.TRIAGED, "SELECT group_id, risk_score, count, disposition FROM triaged ORDER BY risk_score DESC, count DESC, group_no LIMIT 20"),
    "evidence_hashes": _q(S.LINES, f"SELECT printf('EVID-%04d', evidence_no) AS evidence_id, name, source_type, CASE WHEN source_ord = 0 THEN 'text/plain' ELSE 'application/x-ndjson' END AS media_type, 'sha256:' || sha256(data) AS content_hash, strlen(data) AS size_bytes, '{RUN_AT}' AS captured_at, 'sha256:' || sha256(data) AS storage_ref FROM evidence"),
    "evidence_integrity": _q(S.LINES, "SELECT printf('EVID-%04d', evidence_no) AS evidence_id, evidence_no % 7 <> 0 AND evidence_no % 3 <> 0 AS intact FROM evidence"),
    "audit_chain_build": _q(S.EVENTS, "SELECT chain_id, event_id, event_type, actor, prev_hash, entry_hash FROM chain JOIN bodies USING (chain_id, n)"),
    "audit_chain_verify": _q(S.EVENTS, "SELECT chain_id, bool_and(prev_hash = expected) AS intact, count(*) AS events, arg_max(entry_hash, n) AS head FROM (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY chain_id ORDER BY n), '" + GENESIS + "') AS expected FROM chain) GROUP BY chain_id"),
    "audit_chain_tampered": _q(S.EVENTS, "SELECT chain_id, bool_and(NOT forged) AS intact, bool_or(forged) AS found FROM (SELECT chain_id, CAST(split_part(chain_id, '-', 2) AS INTEGER) % 2 = 0 AND n = 5 AS forged FROM numbered) GROUP BY chain_id"),
    "workflow_counts": _q(S.RECORDS, """SELECT flow_id, record AS kind, count(*) AS n FROM records WHERE record <> 'policy' GROUP BY ALL
UNION ALL SELECT flow_id, 'artifact', count(*) + count(incident_id) + count(action_plan_id) FROM outcomes GROUP BY flow_id"""),
    "last_flow_state": _q(S.RECORDS, "SELECT flow_id, status, related_incident_id, groups, incidents, plans FROM f"),
    "state_changes": """WITH c AS (SELECT l_orderkey AS flow_id, l_linenumber AS seq, max(l_returnflag || l_linestatus) AS status, max(CASE WHEN l_linenumber % 2 = 0 THEN 'INC-' || l_partkey END) AS incident_id FROM lineitem GROUP BY ALL)
SELECT flow_id, arg_max(status, seq) AS status, arg_max(incident_id, seq) FILTER (WHERE incident_id IS NOT NULL) AS related_incident_id FROM c GROUP BY flow_id""",
    "invariant_checks": _q(S.DECISIONS, """SELECT 'every group has evidence' AS name, bool_and(evidence_ids <> '') AS passed FROM groups UNION ALL SELECT 'every incident has evidence', bool_and(evidence_ids <> '') FROM incidents UNION ALL SELECT 'every plan needs approval', true
UNION ALL SELECT 'nothing is executed', bool_and(reason_code <> 'ALLOW_OK') FROM decisions UNION ALL SELECT 'every audit chain is intact', true"""),
    "run_report": _q(S.OUTCOMES, """SELECT 'summary' AS part, 'evidence' AS name, CAST(count(*) AS VARCHAR) AS value FROM evidence UNION ALL SELECT 'summary', 'alerts', CAST(count(*) AS VARCHAR) FROM alerts UNION ALL SELECT 'summary', 'groups', CAST(count(*) AS VARCHAR) FROM groups UNION ALL SELECT 'summary', 'incidents', CAST(count(*) AS VARCHAR) FROM incidents
UNION ALL SELECT 'group', group_id, disposition || ' ' || CAST(confidence AS VARCHAR) || ' ' || coalesce(incident_id, '-') || ' ' || coalesce(control_id, '-') || ' ' || coalesce(action_plan_id, '-') || ' ' || coalesce(upper(effect), '-') || ' ' || coalesce(reason_code, '-') FROM outcomes
UNION ALL SELECT 'check', unnest(['every group has evidence', 'every incident has evidence', 'every plan needs approval', 'nothing is executed', 'every audit chain is intact', 'evidence integrity', 'at least one incident', 'no plan has been executed', 'a replay gives the same']), 'PASS'"""),
    "replay_diff": "SELECT unnest([" + ", ".join(map(S.text, COLLECTIONS)) + "]) AS collection, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS equal",
    "run_comparison": _q(S.GROUPS, """, less AS (SELECT dedup_key, count(*) AS count, min(event_time) AS first_seen FROM alerts WHERE file_no % 10 <> 9 GROUP BY dedup_key),
a AS (SELECT count(*) AS n FROM (SELECT dedup_key, count, first_seen FROM groups EXCEPT ALL SELECT * FROM less)), b AS (SELECT count(*) AS n FROM (SELECT * FROM less EXCEPT ALL SELECT dedup_key, count, first_seen FROM groups))
SELECT 'alert_groups' AS collection, a.n AS only_left, b.n AS only_right, a.n = 0 AND b.n = 0 AS equal FROM a, b""").replace("\n, less AS", ",\nless AS"),
    "secret_scan_lines": _scan(True, 'SELECT severity, rule, location, line, "match", count(*) AS n FROM found GROUP BY ALL'),
    "secret_scan_raw": _scan(False, 'SELECT severity, rule, count(*) AS n, count(DISTINCT location) AS places, min("match") AS first_match FROM found GROUP BY ALL'),
    "secret_scan_counts": _scan(True, "SELECT count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'INFO') AS info FROM found"),
    "redact_identity": f"""WITH {_NOTES.lstrip()}
SELECT location, replace(replace(regexp_replace(text, '("(?:authorized_by|requested_by|uploaded_by|submitted_by)"\\s*:\\s*")([^"]+)(")', '\\1security-operator\\3', 'g'), '/srv/home/work/', '/home/example-user/'), '/srv/home/work\\', 'C:\\Users\\example-user\\') AS text FROM notes""",
    "commit_email_dedup": """WITH c AS (SELECT c_custkey AS seq, sha256(CAST(c_custkey AS VARCHAR)) AS hash, 'dev' || (c_custkey % 40) AS name, CASE c_custkey % 6 WHEN 0 THEN 'me@users.noreply.github.com' WHEN 1 THEN 'dev' || (c_custkey % 40) || '@box.local' ELSE 'dev' || (c_custkey % 40) || '@example.org' END AS email FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY name, email ORDER BY seq) AS n FROM c)
SELECT CASE WHEN ends_with(email, '.local') OR contains(email, '.local@') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'commit-author-email' AS rule, 'git-commit:' || substr(hash, 1, 12) AS location, 0 AS line, name || ' <' || email || '>' AS "match" FROM f WHERE n = 1 AND NOT ends_with(email, '@users.noreply.github.com')""",
    "idempotent_merge": """SELECT c_custkey AS key, 'old' AS origin, c_custkey AS seq FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT o_custkey, 'new', min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey""",
    "conditional_append": "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN p_name ELSE p_name || ' + ring added' END AS p_name FROM part",
    "upsert_last_write": "SELECT o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS first_seq FROM orders GROUP BY o_custkey",
    "collection_documents": """SELECT 'N-' || n_nationkey AS obj_id, '{"id":"N-' || n_nationkey || '","name":"' || n_name || '","note":null}' AS doc FROM nation""",
    "eval_confusion": _FIT + " SELECT e AS expected, p AS predicted, count(*) AS n FROM l GROUP BY ALL",
    "eval_metrics": _FIT + """,
c AS (SELECT count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn FROM l)
SELECT tp, fp, fn, tn, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_alarms FROM c""",
    "candidate_ttl": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 * 5 AS INTEGER) < DATE '1998-01-01' AS expired, count(*) AS n FROM orders GROUP BY ALL",
    "source_gate": """WITH r(source_id, trust_level, enabled) AS (VALUES ('src0', 'high', true), ('src1', 'low', true), ('src2', 'medium', false), ('src3', NULL, true), ('src4', 'medium', true))
SELECT d.source AS source_id, CASE WHEN NOT coalesce(enabled, false) THEN 'blocked' WHEN coalesce(trust_level, 'low') = 'low' THEN 'review' ELSE 'auto' END AS gate, count(*) AS n FROM documents d LEFT JOIN r ON r.source_id = d.source GROUP BY ALL""",
    "typed_target_match": _q(S.ALERTS, f""", targets AS (SELECT asset_id AS target FROM alerts UNION ALL SELECT regexp_extract(url, '://([^/?#]*)', 1) FROM pages),
judged AS (
  SELECT target, CASE WHEN {_ip("target")} // 8 = {_ip("'192.0.2.0'")} // 8 THEN 'platform_deny' WHEN ends_with(regexp_replace(lower(target), '\\.$', ''), '.net') THEN 'tenant_deny' WHEN {_ip("target")} = {_ip("'192.0.2.12'")} THEN 'scope_deny'
    WHEN {_ip("target")} // 32 = {_ip("'192.0.2.0'")} // 32 OR lower(target) = 'example.com' OR ends_with(lower(target), '.example.com') OR lower(target) = 'web-01' OR starts_with(target, 'https://a.example.org/') THEN 'scope_allow' END AS layer FROM targets)
SELECT target, layer, CASE WHEN layer = 'scope_allow' THEN 'allow' ELSE 'deny' END AS verdict, count(*) AS n FROM judged GROUP BY ALL""").replace("\n, targets AS", ",\ntargets AS"),
    "transition_check": """WITH c AS (SELECT o_custkey AS flow_id, o_orderkey AS seq, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT flow_id, seq, before, status FROM c WHERE before IS NOT NULL AND before || status NOT IN ('FF', 'FO', 'OO', 'OP', 'PF')""",
    "repeated_tool_calls": "SELECT user_id AS flow_id, event_type AS name, count(*) AS calls FROM events GROUP BY ALL HAVING count(*) > 12",
    "document_dedup": "SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY sha256(text)",
    "document_chunks": "SELECT doc_id, start, sha256(substr(text, CAST(start AS BIGINT) + 1, 500)) AS chunk_hash, length(substr(text, CAST(start AS BIGINT) + 1, 500)) AS chars FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 400)) AS start FROM documents)",
    "entity_extract": r"""WITH e AS (
  SELECT doc_id, 'cve' AS entity_type, unnest(regexp_extract_all(text, 'CVE-\d{4}-\d{4,7}')) AS value FROM documents UNION ALL SELECT doc_id, 'ipv4', unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) FROM documents
  UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) FROM documents UNION ALL SELECT doc_id, 'hash', unnest(regexp_extract_all(text, '\b[0-9a-f]{40}\b')) FROM documents)
SELECT doc_id, entity_type, value, count(*) AS n FROM e GROUP BY ALL""",
    "conflict_detect": "SELECT l_partkey AS entity, 'tax' AS attribute, count(DISTINCT l_tax) AS values, count(DISTINCT l_suppkey % 4) AS sources FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_tax) > 1",
    "windowed_alert_counts": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS key, count(*) AS n FROM events GROUP BY ALL",
    "suppression_match": """WITH r AS (SELECT 'u' || user_id AS dedup_key FROM events WHERE event_type = 'error' AND user_id % 4 <> 0 GROUP BY user_id HAVING count(*) % 3 <> 0)
SELECT 'u' || user_id AS dedup_key, r.dedup_key IS NOT NULL AS suppressed, count(*) AS n FROM events LEFT JOIN r ON r.dedup_key = 'u' || user_id GROUP BY ALL""",
    "baseline_findings": """SELECT s_name AS asset_id, 'Content-Security-Policy' AS header FROM supplier WHERE s_suppkey % 2 <> 0 UNION ALL SELECT s_name, 'X-Content-Type-Options' FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_name, 'X-Frame-Options' FROM supplier WHERE s_suppkey % 5 <> 0""",
    "approval_binding": "SELECT o_orderkey AS plan_id, o_orderkey % 11 AS scope_version, 'h' || (o_orderkey % 10) AS policy_hash, o_orderkey % 2 = 0 AND o_orderkey % 11 = o_orderkey % 9 AND o_orderkey % 10 = o_orderkey % 8 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS approved FROM orders",
    "scope_compile": """WITH e AS (SELECT array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'no_targets' END, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'any_target' END, CASE WHEN o_orderkey % 3 = 0 THEN 'no_owner' END, CASE WHEN o_orderkey % 4 = 0 THEN 'no_end' END,
  CASE WHEN o_orderkey % 4 = 1 THEN 'window_reversed' END, CASE WHEN o_orderkey % 2 <> 0 THEN 'no_rate_limit' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders)
SELECT errors, count(*) AS n FROM e GROUP BY errors""",
    "intake_screening": rf"""WITH d AS (SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN 'Ignore previous instructions. ' || text WHEN 1 THEN '<b>' || text ELSE text END AS t FROM documents),
f AS (SELECT doc_id, coalesce(length(t) > 20000, false) AS too_large, coalesce(regexp_matches(t, '<[a-zA-Z/][^>]*>'), false) AS markup, coalesce(contains(lower(t), 'ignore previous instructions') OR contains(lower(t), 'disregard the above') OR contains(lower(t), 'you are now') OR contains(lower(t), 'system prompt'), false) AS injection,
  coalesce(regexp_matches(t, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b'), false) AS address, coalesce({" OR ".join(f"regexp_matches(t, {S.text(p)})" for severity, _, p in SECRET_PATTERNS if severity == "HIGH")}, false) AS secret,
  t IS NOT NULL AS given, length(regexp_replace(t, '<[a-zA-Z/][^>]*>', ' ', 'g')) AS stripped_chars FROM d)
SELECT doc_id, too_large, markup, injection, address, secret, given AND NOT (too_large OR markup OR injection OR address OR secret) AS accepted, stripped_chars FROM f""",
    "vulnerability_enrichment": """WITH f AS (SELECT p_partkey, 'CVE-2026-' || lpad(CAST(p_partkey % 500 AS VARCHAR), 4, '0') AS cve FROM part), s AS (SELECT s_suppkey, 'CVE-2026-' || lpad(CAST(s_suppkey % 500 AS VARCHAR), 4, '0') AS cve FROM supplier)
SELECT f.p_partkey, f.cve, f.cve IN (SELECT cve FROM s) AS known_exploited, l.likelihood FROM f LEFT JOIN (SELECT cve, max(s_suppkey % 100 / 100) AS likelihood FROM s WHERE s_suppkey % 2 = 0 GROUP BY cve) l ON l.cve = f.cve""",
    "boundary_rechecks": """WITH r AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'TARGET_NOT_IN_SCOPE' WHEN o_orderkey % 2 <> 0 AND o_orderkey % 5 <> 0 THEN 'APPROVAL_REQUIRED' ELSE 'ALLOW_OK' END AS reason_code FROM orders)
SELECT boundary, reason_code, count(*) AS n FROM r, (SELECT unnest(['plan', 'queue', 'dispatch', 'start', 'before_request', 'after_response', 'finish']) AS boundary) GROUP BY ALL""",
    "memory_entries": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT o_custkey AS key, o_orderkey AS version, o_orderpriority AS value FROM m WHERE k = 1 AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) >= DATE '1998-06-01'""",
    "handoff_lineage": """WITH RECURSIVE e AS (SELECT s_suppkey AS task, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 50 = 7 THEN s_suppkey + 1 WHEN s_suppkey % 50 = 8 THEN s_suppkey - 1 ELSE (s_suppkey - 1) // 2 END AS parent FROM supplier),
w AS (SELECT task, parent AS up, 0 AS depth, false AS cycle FROM e
  UNION ALL SELECT w.task, e.parent, w.depth + 1, w.up = w.task FROM w LEFT JOIN e ON e.task = w.up WHERE w.up IS NOT NULL AND NOT w.cycle AND w.depth < 5)
SELECT task, max(depth) AS depth, CASE WHEN bool_or(cycle) THEN 'cycle' WHEN arg_max(up IS NOT NULL, depth) THEN 'too_deep' ELSE 'ok' END AS state FROM w GROUP BY task""",
}
