"""Workflow records: the tasks, steps, tool calls and artifacts of one flow, and the audit events they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.text import canonical_json, number

# fixed values: what one flow does, in order. place, record, name, kind, and which groups have it (all, incident, plan); place 0 is the flow's
STAGES = (
    (0, "task", "Ingest and normalize alerts", None, "flow"), (1, "step", "ingest_sources", "deterministic", "flow"), (2, "tool_call", "ingest.run", None, "flow"),
    (10, "task", "Triage", None, "all"), (11, "step", "ai_triage", "agent", "all"), (12, "tool_call", "soc.triage_group", None, "all"),
    (20, "task", "Map", None, "incident"), (21, "step", "grc_mapping", "deterministic", "incident"), (22, "tool_call", "grc.map_incident", None, "incident"),
    (30, "task", "Plan", None, "incident"), (31, "step", "build_action_plan", "deterministic", "incident"), (32, "step", "policy_gate", "policy", "plan"), (33, "policy", "policy.evaluate", None, "plan"), (34, "tool_call", "policy.evaluate", None, "plan"),
)
#: Places of a group in the sequence of a flow's events.
PER_GROUP = 100


def records(outcomes: DataFrame) -> DataFrame:
    """Rows (flow_id, seq, record, record_id, name, kind, and the group's columns) of a flow, from outcomes (flow_id, group_no, group_id, incident_id, action_plan_id, agent_run_id, effect, reason_code)."""
    spark = outcomes.sparkSession
    stages = spark.createDataFrame(list(STAGES), "place int, record string, stage string, kind string, who string")
    who = F.when(F.col("who") == "all", True).when(F.col("who") == "incident", F.col("incident_id").isNotNull()).when(F.col("who") == "plan", F.col("action_plan_id").isNotNull()).otherwise(False)
    per_group = outcomes.crossJoin(F.broadcast(stages.where("who <> 'flow'"))).where(who)
    name = F.when(F.col("stage") == "Triage", F.concat(F.lit("Triage "), "group_id")).when(F.col("stage") == "Map", F.concat(F.lit("Map "), "incident_id", F.lit(" to controls and risk"))).when(F.col("stage") == "Plan", F.concat(F.lit("Plan remediation for "), "incident_id")).otherwise(F.col("stage"))
    per_group = per_group.withColumns({"seq": F.col("group_no") * PER_GROUP + F.col("place"), "name": name})
    columns = ["flow_id", "seq", "record", "name", "kind", "group_id", "incident_id", "action_plan_id", "agent_run_id", "effect", "reason_code"]
    flow = outcomes.select("flow_id").distinct().crossJoin(F.broadcast(stages.where("who = 'flow'")))
    none = F.lit(None).cast("string")
    flow = flow.withColumns({"seq": F.col("place").cast("long"), "name": F.col("stage")} | {c: none for c in columns[5:]})
    both = flow.select(columns).unionByName(per_group.select(columns))
    n = F.row_number().over(Window.partitionBy("flow_id", "record").orderBy("seq"))
    ids = F.when(F.col("record") == "task", number("TASK", n)).when(F.col("record") == "step", number("STEP", n)).when(F.col("record") == "tool_call", number("TC", n)).otherwise(F.col("action_plan_id"))
    return both.withColumn("record_id", ids)


def artifacts(outcomes: DataFrame) -> DataFrame:
    """One row per artifact: flow_id, kind, ref; they leave no audit events."""
    kinds = (("alert_group", "group_id"), ("incident", "incident_id"), ("action_plan", "action_plan_id"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("ref")) for k, c in kinds))
    return outcomes.select("flow_id", F.explode(each).alias("x")).select("flow_id", "x.*").where("ref is not null")


def events(recs: DataFrame, flows: DataFrame, actor: str, at: str) -> DataFrame:
    """The audit events of flows (flow_id, flow_type, title, status) and their records, in order within each flow."""
    kinds = {"task": "task.started", "step": "step.ran", "tool_call": "tool.called", "policy": "policy.decision"}
    event = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("record"))

    def payload() -> Column:
        return (
            F.when(F.col("record") == "task", canonical_json(name=F.col("name")))
            .when(F.col("record") == "step", canonical_json(name=F.col("name"), kind=F.col("kind")))
            .when(F.col("record") == "policy", canonical_json(effect=F.col("effect"), reason_code=F.col("reason_code")))
            .otherwise(canonical_json(tool=F.col("name"), status=F.lit("ok")))
        )

    policy = F.col("record") == "policy"
    who = F.when(policy, actor).when(F.col("name") == "soc.triage_group", F.col("agent_run_id")).otherwise("system")
    mine = recs.select(F.col("flow_id").alias("chain_id"), (F.col("seq") + 1).alias("seq"), who.alias("actor"), event.alias("event_type"), F.when(~policy, F.col("flow_id")).alias("flow_id"), F.col("record_id").alias("subject_ref"), payload().alias("payload"))
    start = flows.select(F.col("flow_id").alias("chain_id"), F.lit(0).cast("long").alias("seq"), F.lit("system").alias("actor"), F.lit("flow.started").alias("event_type"), "flow_id", F.lit(None).cast("string").alias("subject_ref"), canonical_json(flow_type=F.col("flow_type"), title=F.col("title")).alias("payload"))
    end = flows.select(F.col("flow_id").alias("chain_id"), F.lit(2**62).alias("seq"), F.lit("system").alias("actor"), F.lit("flow.status_changed").alias("event_type"), "flow_id", F.lit(None).cast("string").alias("subject_ref"), canonical_json(status=F.col("status")).alias("payload"))
    return start.unionByName(mine).unionByName(end).withColumn("recorded_at", F.lit(at))


def last_state(changes: DataFrame) -> DataFrame:
    """The last status and incident of each flow from changes (flow_id, seq, status, incident_id): the last written value wins."""
    return changes.groupBy("flow_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("incident_id", F.when(F.col("incident_id").isNotNull(), F.col("seq"))).alias("related_incident_id"))


def repeated_calls(calls: DataFrame, most: int) -> DataFrame:
    """Tools called more than `most` times in a flow (flow_id, name): an agent that may be stuck. Design-level extension."""
    return calls.groupBy("flow_id", "name").agg(F.count("*").alias("calls")).where(F.col("calls") > most)


def bad_transitions(changes: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Status changes (flow_id, seq, status) that the table of allowed pairs does not have. Design-level extension."""
    before = changes.withColumn("before", F.lag("status").over(Window.partitionBy("flow_id").orderBy("seq"))).where("before is not null")
    pairs = changes.sparkSession.createDataFrame(allowed, "before string, status string")
    return before.join(F.broadcast(pairs), ["before", "status"], "left_anti").select("flow_id", "seq", "before", "status")
