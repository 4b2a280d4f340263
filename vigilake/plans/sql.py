"""The same steps as DuckDB SQL: common table expressions that the queries' SQL twins are put together from."""

from __future__ import annotations

from vigilake.functions import knowledge as K
from vigilake.plans.flow import RUN_AT


def case(key: str, values: dict, default: str = "NULL") -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + f" ELSE {default} END)"


def text(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


SSH = r"^(\w{3})\s+(\d+)\s+([\d:]+)\s+(\S+)\s+sshd\[\d+\]:\s+Failed password for (\S+) from (\d+\.\d+\.\d+\.\d+)"
_part = lambda k: f"regexp_extract(line, '{SSH}', {k})"

LINES = """
rendered AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'linux_auth' ELSE 'suricata_eve' END AS source_type, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS source_ord, event_id // 1000 AS file_no,
    CASE WHEN event_type = 'error' THEN
      strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') || ' ' || CASE WHEN event_id % 6 = 1 THEN 'web-01' ELSE 'host-' || (event_id % 6) END || ' sshd[' || (event_id + 100) || ']: Failed password for '
      || CASE WHEN event_id % 11 = 0 THEN 'invalid user u' ELSE 'u' END || user_id || ' from 198.51.100.' || (user_id % 250) || ' port 22 ssh2'
    ELSE
      '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+0000","event_type":"' || CASE WHEN event_type = 'view' THEN 'flow' ELSE 'alert' END || '","src_ip":"192.0.2.' || (user_id % 40) || '"'
      || CASE WHEN event_type = 'purchase' THEN '' ELSE ',"dest_ip":"203.0.113.' || (event_id % 4) || '"' END || ',"alert":{"signature_id":' || (user_id % 20 + 1000)
      || CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"severity":' || (event_id % 3 + 1) END || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"signature":"rule ' || (user_id % 20) || '"' END || '}}'
    END AS line
  FROM events),
files AS (SELECT source_type, source_ord, file_no, string_agg(line, chr(10) ORDER BY event_id) AS data FROM rendered GROUP BY ALL),
evidence AS (SELECT *, row_number() OVER (ORDER BY source_ord, file_no) AS evidence_no, source_type || '-' || file_no AS name FROM files)"""

ALERTS = LINES + rf""",
placed AS (SELECT r.*, printf('EVID-%04d', e.evidence_no) AS evidence_id, row_number() OVER (PARTITION BY r.source_ord, r.file_no ORDER BY event_id) AS line_no FROM rendered r JOIN evidence e USING (source_ord, file_no)),
auth AS (
  SELECT source_ord, file_no, line_no, evidence_id, 'linux_auth' AS source, 'ssh_failed_password' AS signature, 'Failed SSH password for ' || {_part(5)} || ' from ' || {_part(6)} AS title, {_part(4)} AS asset_id, 'medium' AS severity,
    '{K.YEAR}-' || lpad(CAST({case(_part(1), {m: i for i, m in enumerate(K.MONTHS, 1)})} AS VARCHAR), 2, '0') || '-' || lpad({_part(2)}, 2, '0') || 'T' || {_part(3)} || 'Z' AS event_time, 'ssh_failed_password:' || {_part(4)} || ':' || {_part(6)} AS dedup_key
  FROM placed WHERE source_ord = 0 AND regexp_matches(line, '{SSH}')),
eve AS (
  SELECT source_ord, file_no, line_no, evidence_id, 'suricata_eve' AS source, 'suspicious_outbound_tls' AS signature, coalesce(json_extract_string(line, '$.alert.signature'), 'Suricata alert') AS title, coalesce(json_extract_string(line, '$.src_ip'), 'unknown') AS asset_id,
    {case("CAST(coalesce(json_extract_string(line, '$.alert.severity'), '3') AS INTEGER)", K.EVE_SEVERITY, "'low'")} AS severity, replace(coalesce(json_extract_string(line, '$.timestamp'), ''), '+0000', 'Z') AS event_time,
    'suspicious_outbound_tls:' || coalesce(json_extract_string(line, '$.alert.signature_id'), '0') || ':' || coalesce(json_extract_string(line, '$.src_ip'), 'unknown') || ':' || coalesce(json_extract_string(line, '$.dest_ip'), 'unknown') AS dedup_key
  FROM placed WHERE source_ord = 1 AND json_extract_string(line, '$.event_type') = 'alert'),
alerts AS (SELECT *, row_number() OVER (ORDER BY source_ord, file_no, line_no) AS seq FROM (SELECT * FROM auth UNION ALL SELECT * FROM eve))"""

_weight = lambda x: case(x, K.SEVERITY_WEIGHT)
_score = f"least(100, {_weight('severity')} + least(count, 5) * 5 + {case(case('asset_id', K.ASSET_CRITICALITY, text('low')), K.CRITICALITY_BONUS)})"
_band = "(CASE " + " ".join(f"WHEN risk_score >= {n} THEN '{b}'" for n, b in K.BANDS) + " ELSE 'informational' END)"
GROUPS = ALERTS + f""",
grouped AS (
  SELECT dedup_key, arg_min(signature, seq) AS signature, arg_min(asset_id, seq) AS asset_id, arg_max(severity, {_weight("severity")}) AS severity, count(*) AS count, string_agg(printf('ALERT-%04d', seq), ',' ORDER BY seq) AS alert_ids,
    array_to_string(list_sort(list_distinct(list(evidence_id))), ',') AS evidence_ids, min(event_time) AS first_seen, max(event_time) AS last_seen, min(seq) AS first_seq
  FROM alerts GROUP BY dedup_key),
scored AS (SELECT *, {_score} AS risk_score, row_number() OVER (ORDER BY first_seq) AS group_no FROM grouped),
groups AS (SELECT *, {_band} AS risk_band, printf('AG-%04d', group_no) AS group_id FROM scored)"""

_ssh = "signature = 'ssh_failed_password' AND count >= 3"
_high = "risk_band IN ('high', 'critical')"
TRIAGED = GROUPS + f""",
triaged AS (
  SELECT *, printf('AR-%04d', group_no) AS agent_run_id, {case("signature", {k: v[0] for k, v in K.ATTACK_TECHNIQUES.items()}, "''")} AS attack_techniques,
    CASE WHEN evidence_ids = '' THEN 'monitor' WHEN {_ssh} OR {_high} THEN 'escalate' ELSE 'monitor' END AS disposition, CAST(CASE WHEN evidence_ids = '' THEN 0.3 WHEN {_ssh} THEN 0.85 WHEN {_high} THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence,
    CASE WHEN evidence_ids <> '' AND {_ssh} THEN 'harden_ssh_access' ELSE '' END AS actions,
    CASE WHEN evidence_ids = '' THEN 'No linked evidence; defaulting to monitor.' WHEN {_ssh} THEN count || ' repeated SSH authentication failures for the same source/host indicate credential brute force (T1110).'
      WHEN {_high} THEN 'Risk band ' || risk_band || ' warrants analyst escalation.' ELSE 'Risk band ' || risk_band || '; monitor and enrich before escalation.' END AS rationale
  FROM groups)"""

INCIDENTS = TRIAGED + """,
incidents AS (
  SELECT *, printf('INC-%04d', incident_no) AS incident_id, signature || ' on ' || asset_id AS title
  FROM (SELECT *, row_number() OVER (ORDER BY group_no) AS incident_no FROM triaged WHERE disposition = 'escalate' AND evidence_ids <> '' AND confidence >= 0.5))"""

_controls = ", ".join(f"({text(s)}, {text(c)}, {text(K.CONTROL_LIBRARY[c][1])})" for s, c in K.SIGNATURE_TO_CONTROL.items())
_actions = ", ".join("(" + ", ".join(map(text, (k, *v))) + ")" for k, v in K.ACTION_CATALOG.items())
PLANS = INCIDENTS + f""",
controls(signature, control_id, control_title) AS (VALUES {_controls}),
mappings AS (SELECT *, printf('MAP-%04d', row_number() OVER (ORDER BY incident_no)) AS mapping_id FROM incidents JOIN controls USING (signature)),
actions(action_type, plan_title, risk_level, rollback, parameters) AS (VALUES {_actions}),
plans AS (SELECT *, printf('AP-%04d', plan_no) AS action_plan_id FROM (SELECT i.*, a.*, row_number() OVER (ORDER BY incident_no) AS plan_no FROM incidents i JOIN actions a ON a.action_type = i.actions))"""

#: The default scope covers web-01 and names below example.internal; no plan has an approval.
DECISIONS = PLANS + f""",
decisions AS (
  SELECT *, printf('REQ-%04d', plan_no) AS request_id, CASE WHEN NOT (asset_id = 'web-01' OR (ends_with(asset_id, '.example.internal') AND asset_id <> 'example.internal')) THEN 'TARGET_NOT_IN_SCOPE' WHEN risk_level <> 'low' THEN 'APPROVAL_REQUIRED' ELSE 'AUTONOMY_LEVEL_INSUFFICIENT' END AS reason_code
  FROM plans),
messages(reason_code, message) AS (VALUES {", ".join(f"({text(k)}, {text(v)})" for k, v in K.POLICY_MESSAGES.items())})"""

OUTCOMES = DECISIONS + """,
outcomes AS (
  SELECT printf('FLOW-%04d', (t.group_no - 1) // 50 + 1) AS flow_id, t.group_no, t.group_id, t.signature, t.risk_score, t.risk_band, t.disposition, t.confidence, t.agent_run_id, i.incident_id, i.incident_no, m.control_id, p.action_plan_id, d.reason_code,
    CASE WHEN d.reason_code IS NOT NULL THEN 'deny' END AS effect, i.severity AS impact
  FROM triaged t LEFT JOIN incidents i USING (group_no) LEFT JOIN mappings m USING (group_no) LEFT JOIN plans p USING (group_no) LEFT JOIN decisions d USING (group_no))"""

_records = """
  SELECT flow_id, 0 AS seq, 'task' AS record, 'Ingest and normalize alerts' AS name, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS plan, CAST(NULL AS VARCHAR) AS run, CAST(NULL AS VARCHAR) AS code FROM f
  UNION ALL SELECT flow_id, 1, 'step', 'ingest_sources', 'deterministic', NULL, NULL, NULL FROM f
  UNION ALL SELECT flow_id, 2, 'tool_call', 'ingest.run', NULL, NULL, NULL, NULL FROM f
  UNION ALL SELECT flow_id, group_no * 100 + 10, 'task', 'Triage ' || group_id, NULL, NULL, NULL, NULL FROM outcomes
  UNION ALL SELECT flow_id, group_no * 100 + 11, 'step', 'ai_triage', 'agent', NULL, NULL, NULL FROM outcomes
  UNION ALL SELECT flow_id, group_no * 100 + 12, 'tool_call', 'soc.triage_group', NULL, NULL, agent_run_id, NULL FROM outcomes
  UNION ALL SELECT flow_id, group_no * 100 + 20, 'task', 'Map ' || incident_id || ' to controls and risk', NULL, NULL, NULL, NULL FROM outcomes WHERE incident_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 21, 'step', 'grc_mapping', 'deterministic', NULL, NULL, NULL FROM outcomes WHERE incident_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 22, 'tool_call', 'grc.map_incident', NULL, NULL, NULL, NULL FROM outcomes WHERE incident_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 30, 'task', 'Plan remediation for ' || incident_id, NULL, NULL, NULL, NULL FROM outcomes WHERE incident_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 31, 'step', 'build_action_plan', 'deterministic', NULL, NULL, NULL FROM outcomes WHERE incident_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 32, 'step', 'policy_gate', 'policy', NULL, NULL, NULL FROM outcomes WHERE action_plan_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 33, 'policy', 'policy.evaluate', NULL, action_plan_id, NULL, reason_code FROM outcomes WHERE action_plan_id IS NOT NULL
  UNION ALL SELECT flow_id, group_no * 100 + 34, 'tool_call', 'policy.evaluate', NULL, action_plan_id, NULL, reason_code FROM outcomes WHERE action_plan_id IS NOT NULL"""
RECORDS = OUTCOMES + f""",
f AS (SELECT flow_id, CASE WHEN bool_or(action_plan_id IS NOT NULL) THEN 'waiting_for_approval' ELSE 'completed' END AS status, arg_max(incident_id, group_no) FILTER (WHERE incident_id IS NOT NULL) AS related_incident_id, count(*) AS groups, count(incident_id) AS incidents, count(action_plan_id) AS plans FROM outcomes GROUP BY flow_id),
raw_records AS ({_records}),
records AS (
  SELECT *, CASE record WHEN 'task' THEN printf('TASK-%04d', n) WHEN 'step' THEN printf('STEP-%04d', n) WHEN 'tool_call' THEN printf('TC-%04d', n) ELSE plan END AS record_id
  FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, record ORDER BY seq) AS n FROM raw_records))"""

EVENTS = RECORDS + f""",
ev AS (
  SELECT flow_id AS chain_id, CAST(0 AS BIGINT) AS seq, 'system' AS actor, 'flow.started' AS event_type, flow_id, CAST(NULL AS VARCHAR) AS subject_ref, '{{"flow_type":"soc_investigation","title":"Investigation of ' || flow_id || '"}}' AS payload FROM f
  UNION ALL SELECT flow_id, 4611686018427387904, 'system', 'flow.status_changed', flow_id, CAST(NULL AS VARCHAR), '{{"status":"' || status || '"}}' FROM f
  UNION ALL SELECT flow_id, seq + 1, CASE WHEN record = 'policy' THEN 'security-operator' WHEN name = 'soc.triage_group' THEN run ELSE 'system' END,
    CASE record WHEN 'task' THEN 'task.started' WHEN 'step' THEN 'step.ran' WHEN 'tool_call' THEN 'tool.called' ELSE 'policy.decision' END, CASE WHEN record <> 'policy' THEN flow_id END, record_id,
    CASE record WHEN 'task' THEN '{{"name":"' || name || '"}}' WHEN 'step' THEN '{{"kind":"' || kind || '","name":"' || name || '"}}' WHEN 'tool_call' THEN '{{"status":"ok","tool":"' || name || '"}}' ELSE '{{"effect":"deny","reason_code":"' || code || '"}}' END FROM records),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS n FROM ev),
bodies AS (
  SELECT chain_id, seq, n, printf('AUD-%04d', n) AS event_id, event_type, actor, '{{"actor":"' || actor || '","event_id":"' || printf('AUD-%04d', n) || '","event_type":"' || event_type || '","flow_id":' || coalesce('"' || flow_id || '"', 'null') || ',"payload":' || payload || ',"prev_hash":"' AS head,
    '","recorded_at":"{RUN_AT}","subject_ref":' || coalesce('"' || subject_ref || '"', 'null') || '}}' AS tail
  FROM numbered),
chain AS (
  SELECT chain_id, n, 'sha256:' || repeat('0', 64) AS prev_hash, 'sha256:' || sha256(head || 'sha256:' || repeat('0', 64) || tail) AS entry_hash FROM bodies WHERE n = 1
  UNION ALL SELECT b.chain_id, b.n, c.entry_hash, 'sha256:' || sha256(b.head || c.entry_hash || b.tail) FROM chain c JOIN bodies b ON b.chain_id = c.chain_id AND b.n = c.n + 1)"""


def query(steps: str, select: str) -> str:
    return f"WITH RECURSIVE {steps.lstrip()}\n{select}"
