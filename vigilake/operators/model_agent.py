"""A triage agent backed by a model: fitted to decisions on a bounded sample, then applied to all groups in Arrow batches.

The model is a logistic regression on what a group's row says (severity, count, score, evidence, time span, signature).
It is fitted on the driver to SAMPLE groups at most, those of the least hashes of their keys, by a fixed number of Newton
steps, so that the same decisions give the same model; its weights (some dozens of numbers) go to every task. Every group is
judged. What the rules forbid stays forbidden: without evidence nothing is escalated, whatever the model says.

Defined results: a null or unknown severity, score, count, signature or time counts as a value of its own that says nothing; a
group with a null evidence count has none; a model without decisions of both kinds gives their share alone; with none at all
everything is monitored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.functions.knowledge import SEVERITY_WEIGHT

#: Groups that a model is fitted to at most, Newton steps, ridge, and places for signatures.
SAMPLE, STEPS, RIDGE, SIGNATURES = 2000, 25, 1e-3, 16
#: From this probability on a group is escalated.
ESCALATE = 0.5
RESULT = "disposition string, confidence double, rationale string, recommended_action_types array<string>"


def _features() -> Column:
    """What the model sees of a group's row, null where it is not known."""
    number = lambda x: x.cast("double")
    seen = lambda c: F.try_to_timestamp(F.col(c))
    span = F.unix_seconds(seen("last_seen")) - F.unix_seconds(seen("first_seen"))
    return F.struct(F.col("severity").alias("severity"), number(F.col("count")).alias("count"), number(F.col("risk_score")).alias("score"), number(F.coalesce("evidence_count", F.lit(0))).alias("evidence"), number(span).alias("span"), F.col("signature").alias("signature"))


def _matrix(x: pa.StructArray) -> np.ndarray:
    get = lambda name: x.field(x.type.get_field_index(name))
    number = lambda name: np.nan_to_num(get(name).to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
    known = lambda name: (~np.isnan(get(name).to_numpy(zero_copy_only=False).astype(np.float64))).astype(np.float64)
    rank = np.array([SEVERITY_WEIGHT.get(s, 0) / 100 for s in get("severity").to_pylist()])
    columns = [np.ones(len(x)), rank, np.log1p(np.maximum(number("count"), 0)), number("score") / 100, np.log1p(np.maximum(number("evidence"), 0)), np.log1p(np.maximum(number("span"), 0)) / 10, known("count"), known("score"), known("span")]
    place = np.array([-1 if s is None else md5(s.encode()).digest()[0] % SIGNATURES for s in get("signature").to_pylist()], np.int64)
    return np.column_stack([*columns, (place[:, None] == np.arange(SIGNATURES)).astype(np.float64)])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + RIDGE * len(y) * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * len(y) * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


@dataclass(frozen=True)
class ModelAgent:
    """A named, versioned model; used where a rule agent is (`triage.triage`, `triage.agent_runs`)."""

    name: str
    version: str
    weights: tuple[float, ...] = field(repr=False)

    def judge(self, groups: DataFrame) -> DataFrame:
        """groups with the columns of RESULT."""
        held = groups.sparkSession.sparkContext.broadcast(np.array(self.weights))
        schema = T.StructType([*groups.schema.fields, *T.StructType.fromDDL(RESULT).fields])
        return groups.withColumn("__x", _features()).mapInArrow(_judged(held), schema)


def _judged(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("__x"))
            m = _matrix(x)
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30))) if len(w) else np.zeros(len(m))
            evidence = m[:, 4] > 0
            up = evidence & (p >= ESCALATE)
            confidence = np.where(evidence, np.round(np.maximum(p, 1 - p), 4), 0.3)
            why = ["No linked evidence; defaulting to monitor." if not e else f"Model gives escalation {v:.3f}." for e, v in zip(evidence, p, strict=True)]
            keep = [k for k, name in enumerate(batch.schema.names) if name != "__x"]
            columns = [*(batch.column(k) for k in keep), pa.array(np.where(up, "escalate", "monitor").tolist(), pa.string()), pa.array(confidence), pa.array(why, pa.string()), pa.array([[]] * len(m), pa.list_(pa.string()))]
            yield pa.record_batch(columns, [*(batch.schema.names[k] for k in keep), "disposition", "confidence", "rationale", "recommended_action_types"])

    return run


def fit_agent(decided: DataFrame, version: str, name: str = "soc.model", sample: int = SAMPLE) -> ModelAgent:
    """An agent fitted to decided groups (a group's row and disposition): to those of the least hashes of dedup_key, `sample` of them at most."""
    rows = decided.where("disposition is not null").select(F.xxhash64("dedup_key").alias("h"), "dedup_key", _features().alias("x"), (F.col("disposition") == "escalate").cast("double").alias("y"))
    got = rows.orderBy("h", "dedup_key").limit(sample).select("x", "y").toArrow().combine_chunks()
    if not got.num_rows:
        return ModelAgent(name, version, ())
    x = got.column("x").combine_chunks() if isinstance(got.column("x"), pa.ChunkedArray) else got.column("x")
    return ModelAgent(name, version, tuple(_fit(_matrix(x), got.column("y").to_numpy()).tolist()))


class Registry:
    """Agents by name and version, of either kind."""

    def __init__(self, *agents):
        self.agents: dict[tuple[str, str], object] = {}
        for a in agents:
            self.add(a)

    def add(self, agent) -> None:
        """Register an agent; a version that is there is not replaced."""
        if (agent.name, agent.version) in self.agents:
            raise ValueError(f"{agent.name} {agent.version} is registered already")
        self.agents[agent.name, agent.version] = agent

    def resolve(self, name: str, version: str | None = None):
        """The agent of that version, or of the last one that was added."""
        found = [a for (n, v), a in self.agents.items() if n == name and version in (None, v)]
        if not found:
            raise KeyError(f"no agent {name} {version or ''}")
        return found[-1]
