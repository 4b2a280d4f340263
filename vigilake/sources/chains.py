"""Audit chains that are kept and appended to: heads are read and advanced in one step, and a fork of a chain is refused.

An append goes on from the heads of the version that it has read, writes its events and the new heads into folders of their
own, and then creates the next version's file, which names both. If another writer was there first the file exists, the append
is refused and what it wrote is never read; the caller reads again and tries again. (The file system must create files
atomically, as HDFS does.) Events of a version are never changed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import audit
from vigilake.sources.store import children, create_text

HEADS = "chain_id string, events long, head string, last_seq long"


class ForkRefused(RuntimeError):
    """The append does not go on from the chains' heads."""


@dataclass(frozen=True)
class ChainStore:
    spark: SparkSession
    path: str

    def version(self) -> int:
        """The number of appends so far."""
        return max((int(n) for n in children(self.spark, f"{self.path}/versions") if n.isdigit()), default=0)

    def _parts(self, version: int) -> list[dict]:
        names = [f"{self.path}/versions/{v:010d}" for v in range(1, version + 1)]
        return [json.loads(r.value) for r in self.spark.read.text(names, wholetext=True).collect()] if names else []  # a line for each append

    def heads(self, version: int | None = None) -> DataFrame:
        """(chain_id, events, head, last_seq) of all chains."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], HEADS)
        part = json.loads(self.spark.read.text(f"{self.path}/versions/{at:010d}", wholetext=True).first().value)
        return self.spark.read.schema(HEADS).parquet(f"{self.path}/{part['heads']}")

    def events(self) -> DataFrame | None:
        """All events of all chains; None before the first append."""
        parts = self._parts(self.version())
        return self.spark.read.parquet(*(f"{self.path}/{p['events']}" for p in parts)) if parts else None

    def append(self, events: DataFrame, version: int | None = None) -> int:
        """Append events (as `audit.chained` takes them) to their chains; returns the new version.

        version: the one that the caller has read (default: the latest). Refused if there is a later one by the end, or if an event
        does not come after its chain's last one.
        """
        at = self.version() if version is None else version
        heads = self.heads(at)
        behind = events.join(heads.select("chain_id", "last_seq"), "chain_id").where("seq <= last_seq or seq is null")
        if at < self.version() or behind.take(1):
            raise ForkRefused(f"version {at} is not the latest, or events do not come after their chains' last ones")
        part = {"events": f"events-{uuid.uuid4().hex}", "heads": f"heads-{uuid.uuid4().hex}"}
        audit.chained(events, heads).write.parquet(f"{self.path}/{part['events']}")
        new = audit.heads(self.spark.read.parquet(f"{self.path}/{part['events']}"))
        both = heads.withColumn("last", F.lit(0)).unionByName(new.withColumn("last", F.lit(1)))
        latest = both.groupBy("chain_id").agg(F.sum("events").alias("events"), F.max_by("head", "last").alias("head"), F.max("last_seq").alias("last_seq"))
        latest.write.parquet(f"{self.path}/{part['heads']}")
        if not create_text(self.spark, f"{self.path}/versions/{at + 1:010d}", json.dumps(part)):
            raise ForkRefused(f"version {at + 1} was made by another writer")
        return at + 1

    def verified(self) -> DataFrame:
        """Each chain's state (see `audit.chain_state`) with anchored: it ends at the head that is kept, so that a cut tail shows."""
        state = audit.chain_state(self.events())
        kept = self.heads().select("chain_id", F.col("events").alias("__events"), F.col("head").alias("__head"))
        whole = F.col("intact") & (F.col("events") == F.col("__events")) & (F.col("head") == F.col("__head"))
        return kept.join(state, "chain_id", "left").withColumn("anchored", F.coalesce(whole, F.lit(False))).drop("__events", "__head")
