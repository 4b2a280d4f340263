"""Policy: scopes bound to the hash of what they permit, and ordered gates that fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.knowledge import dimension
from vigilake.functions.text import canonical_json, checked, content_hash

ACTOR = "security-operator"
#: The autonomy an action needs: low risk without approval, or anything else.
UNATTENDED, AFTER_APPROVAL = 4, 3
#: Requests that do not name their scope are judged by all of them, so many at most.
SCOPES_TRIED = 100
SCOPE = "scope_id string, scope_version int, approved boolean, autonomy_level int, allowed_actors array<string>, target_allowlist array<string>, valid_from string, valid_until string"


def policy_hash() -> Column:
    """The hash over everything that decides: not the scope's id, nor whether it is approved."""
    fields = {c: F.col(c) for c in ("scope_version", "autonomy_level", "valid_from", "valid_until")}
    fields |= {c: F.array_sort(c) for c in ("allowed_actors", "target_allowlist")}
    return content_hash(canonical_json(**fields))


def bound(scopes: DataFrame) -> DataFrame:
    return scopes.withColumn("policy_hash", policy_hash())


def default_scope(spark: SparkSession) -> DataFrame:
    return bound(spark.createDataFrame([("SCOPE-DEMO", 1, True, 1, [ACTOR], ["web-01", "*.example.internal"], None, None)], SCOPE))


def target_allowed(target: Column, allowlist: Column) -> Column:
    """An entry equal to the target, or `*.` and a suffix of it; the bare suffix itself is not covered."""
    wild = lambda e: F.startswith(e, F.lit("*.")) & F.endswith(target, F.substr(e, F.lit(2))) & (target != F.substr(e, F.lit(3)))
    return F.coalesce(F.exists(allowlist, lambda e: (e == target) | wild(e)), F.lit(False))


def reason_code() -> Column:
    """The first gate that is not known to be passed gives the code. Free text of the request is never looked at."""
    def fails(passed: Column) -> Column:
        return ~F.coalesce(passed, F.lit(False))

    given = lambda c: F.nullif(F.col(c), F.lit(""))
    needed = F.when((F.col("risk_level") == "low") & fails(F.col("has_approval")), UNATTENDED).otherwise(AFTER_APPROVAL)
    return (
        F.when(fails(F.col("approved")), "SCOPE_NOT_APPROVED")
        .when(fails(F.col("policy_hash") != ""), "SCOPE_UNBOUND")
        .when(F.col("at").isNull() | fails(given("valid_from").isNull() | (F.col("at") >= given("valid_from"))), "SCOPE_WINDOW_INVALID")
        .when(fails(given("valid_until").isNull() | (F.col("at") <= given("valid_until"))), "SCOPE_EXPIRED")
        .when(fails(F.array_contains("allowed_actors", F.col("actor"))), "ACTOR_NOT_PERMITTED")
        .when(fails(target_allowed(F.col("target"), F.col("target_allowlist"))), "TARGET_NOT_IN_SCOPE")
        .when(fails((F.col("risk_level") == "low") | F.col("has_approval")), "APPROVAL_REQUIRED")
        .when(fails(F.col("autonomy_level") >= needed), "AUTONOMY_LEVEL_INSUFFICIENT")
        .otherwise("ALLOW_OK")
    )


def decide(requests: DataFrame, scope: DataFrame, evaluated_at: str) -> DataFrame:
    """One decision per request and scope, of its own scope_id if requests have one: effect, reason_code, message, request_ref, policy_hash, evaluated_at, and the request's columns."""
    if "scope_id" in requests.columns:
        # a request of an unknown scope meets no approved one and is denied
        both = requests.join(checked(scope), "scope_id", "left")
    else:
        few = scope.limit(SCOPES_TRIED + 1).count()
        if few > SCOPES_TRIED:
            raise ValueError(f"requests without a scope_id are judged by every scope: {SCOPES_TRIED} at most")
        both = requests.crossJoin(F.broadcast(scope))
    both = both.withColumn("reason_code", reason_code())
    out = both.join(F.broadcast(dimension(requests.sparkSession, "messages")), "reason_code")
    return out.withColumns({"effect": F.when(F.col("reason_code") == "ALLOW_OK", "allow").otherwise("deny"), "request_ref": F.col("request_id"), "evaluated_at": F.lit(evaluated_at)})
