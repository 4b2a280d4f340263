"""Reference knowledge: the small fixed tables that scoring, triage, mapping and policy look things up in.

Fixed values: they decide the results, so they are stated here as they are and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = 2026  # of syslog lines, which have none
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ASSET_CRITICALITY = {"web-01": "medium"}
SEVERITY_WEIGHT = {"info": 5, "low": 20, "medium": 45, "high": 70, "critical": 90}
CRITICALITY_BONUS = {"info": 0, "low": 0, "medium": 10, "high": 20, "critical": 30}
BANDS = ((80, "critical"), (60, "high"), (40, "medium"), (20, "low"))
BAND_BY_SEVERITY = {"info": "informational", "low": "low", "medium": "medium", "high": "high", "critical": "critical"}
EVE_SEVERITY = {1: "high", 2: "medium", 3: "low"}
ATTACK_TECHNIQUES = {"ssh_failed_password": ["T1110"], "suspicious_outbound_tls": ["T1071.001"]}
CONTROL_LIBRARY = {"AC-7": ("NIST SP 800-53", "Unsuccessful Logon Attempts"), "SI-4": ("NIST SP 800-53", "System Monitoring")}
SIGNATURE_TO_CONTROL = {"ssh_failed_password": "AC-7", "suspicious_outbound_tls": "SI-4"}
ACTION_CATALOG = {
    "harden_ssh_access": ("Harden SSH access (disable root login, enforce key auth)", "medium", "Restore the previous sshd_config from the pre-change backup and reload sshd.", '{"disable_root_login":true,"enforce_key_auth":true}'),
    "add_security_headers": ("Add baseline HTTP security headers", "low", "Remove the added header directives and reload the web server.", '{"headers":["Content-Security-Policy","X-Frame-Options","X-Content-Type-Options"]}'),
}
POLICY_MESSAGES = {
    "ALLOW_OK": "Action permitted by policy.",
    "SCOPE_NOT_APPROVED": "Scope is not approved; blank/ambiguous scope fails closed.",
    "SCOPE_UNBOUND": "Scope is not bound to a canonical policy hash.",
    "SCOPE_WINDOW_INVALID": "No valid decision time or before the scope validity window.",
    "SCOPE_EXPIRED": "Authorization window has expired.",
    "ACTOR_NOT_PERMITTED": "Actor is not on the scope actor allowlist.",
    "TARGET_NOT_IN_SCOPE": "Target is not covered by the scope allowlist.",
    "APPROVAL_REQUIRED": "Action risk requires an explicit approval record.",
    "AUTONOMY_LEVEL_INSUFFICIENT": "Configured autonomy level is below what this action requires.",
}
#: severity, rule, pattern (Java syntax), and the group whose value is looked at
SECRET_PATTERNS = (
    ("HIGH", "private-key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    ("HIGH", "github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("HIGH", "aws-access-key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("HIGH", "openai-style-key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("HIGH", "slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("HIGH", "google-api-key", r"\bAIza[A-Za-z0-9_-]{30,}\b"),
    ("HIGH", "jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("HIGH", "credential-assignment", r"(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token)\b\s*[:=]\s*[\"']?[^\s\"'`]{8,}[\"']?"),
    ("MEDIUM", "email-address", r"\b[A-Za-z0-9._%+-]+@(?!example\.com\b)[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("MEDIUM", "mac-local-path", r"/Users/[A-Za-z0-9._-]+/"),
    ("MEDIUM", "windows-local-path", r"[A-Za-z]:\\Users\\[A-Za-z0-9._-]+\\"),
    ("MEDIUM", "private-ipv4", r"\b(?:10\.(?:\d{1,3}\.){2}\d{1,3}|192\.168\.(?:\d{1,3}\.)\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.(?:\d{1,3}\.)\d{1,3})\b"),
)
PLACEHOLDERS = ("replace_me", "example.com", "example.internal", "cve-yyyy-nnnn", "placeholder", "security-operator", "users.noreply.github.com")
NO_CREDENTIALS = ("true", "false", "none", "null", "required", "configured")


def lookup(key: Column, values: dict, default: Column | None = None) -> Column:
    """values[key] as an expression; default (null) where the key is not there."""
    out = None
    for k, v in values.items():
        v = F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out if default is None else out.otherwise(default)


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """The tables that are joined: controls, signature_controls, actions, messages."""
    if name == "controls":
        return spark.createDataFrame([(k, *v) for k, v in CONTROL_LIBRARY.items()], "control_id string, framework string, control_title string")
    if name == "signature_controls":
        return spark.createDataFrame(list(SIGNATURE_TO_CONTROL.items()), "signature string, control_id string")
    if name == "actions":
        return spark.createDataFrame([(k, *v) for k, v in ACTION_CATALOG.items()], "action_type string, plan_title string, risk_level string, rollback string, parameters string")
    if name == "messages":
        return spark.createDataFrame(list(POLICY_MESSAGES.items()), "reason_code string, message string")
    raise KeyError(name)
