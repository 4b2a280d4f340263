"""A keyed collection that takes writes in batches: the last write of each key counts, a batch that comes again changes nothing.

Each batch is one table, named by its id, of the last write of each of its keys; writing it again replaces it. The state is the
last of all of them. From time to time a base takes in the batches up to its id, after which these are no longer read. Tables
are laid out by a hash of the key and sorted by it, so that merging goes bucket by bucket and a lookup reads one bucket.
A table counts when it was written whole: what a killed job has left is not read, and is replaced when the batch comes again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.sources.store import children, finished

#: Buckets by hash of the key; a base is made after so many batches.
BUCKETS, BASE_EVERY = 16, 10


@dataclass(frozen=True)
class KeyedTable:
    """The collection in a folder. seq orders the writes of a key; of equal ones the later batch's counts, within a batch the greatest row.

    schema: the writes' columns, key and seq among them. Writes with a null key are left out; a null seq comes before all others.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str
    seq: str
    buckets: int = BUCKETS

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _last(self, writes: DataFrame) -> DataFrame:
        """One row per key of writes (the columns, first_seq, batch)."""
        rest = [c for c in writes.columns if c not in (self.key, self.seq, "first_seq", "batch")]
        whole = F.struct(F.col(self.seq).alias("seq"), "batch", F.struct(*rest).alias("rest"))
        last = writes.groupBy(self.key).agg(F.max(whole).alias("w"), F.min("first_seq").alias("first_seq"))
        return last.select(self.key, F.col("w.seq").alias(self.seq), "w.rest.*", "first_seq", F.col("w.batch").alias("batch"))

    def _write(self, rows: DataFrame, name: str) -> None:
        laid = rows.withColumn("bucket", self._bucket(F.col(self.key))).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key)
        laid.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch; for `foreachBatch`, which may give the same batch again."""
        columns = self.spark.createDataFrame([], self.schema).columns
        writes = batch.select(columns).where(F.col(self.key).isNotNull()).withColumns({"first_seq": F.col(self.seq), "batch": F.lit(batch_id).cast("long")})
        self._write(self._last(writes), f"batch-{batch_id:012d}")
        if batch_id % BASE_EVERY == BASE_EVERY - 1:
            self.compact()

    def tables(self) -> tuple[str | None, list[str]]:
        """The base and the batches that count besides it."""
        whole = [n for n in children(self.spark, self.path) if n.startswith(("base-", "batch-")) and finished(self.spark, f"{self.path}/{n}")]
        base = max((n for n in whole if n.startswith("base-")), default=None)
        since = base.removeprefix("base-") if base else ""
        return base, [n for n in whole if n.startswith("batch-") and n.removeprefix("batch-") > since]

    def _rows(self) -> DataFrame:
        base, batches = self.tables()
        empty = self.spark.createDataFrame([], self.schema)
        out = empty.withColumns({"first_seq": F.col(self.seq), "batch": F.lit(0).cast("long"), "bucket": F.lit(0)}).where("false")
        kind = out.schema
        for name in [*([base] if base else []), *batches]:
            out = out.unionByName(self.spark.read.schema(kind).parquet(f"{self.path}/{name}"))
        return out

    def read(self) -> DataFrame:
        """The last write of each key, with first_seq, the place of its first."""
        return self._last(self._rows().drop("bucket")).drop("batch")

    def get(self, value) -> DataFrame:
        """The row of one key, if there is one: of each table one bucket is read, and of that the row groups that may have the key."""
        rows = self._rows()
        wanted = F.lit(value).cast(rows.schema[self.key].dataType)
        mine = rows.where((F.col("bucket") == self._bucket(wanted)) & (F.col(self.key) == wanted))
        return self._last(mine.drop("bucket")).drop("batch")

    def compact(self) -> None:
        """A base of all batches so far. Readers that began before go on with the tables that they have listed; nothing is deleted."""
        _, batches = self.tables()
        if batches:
            self._write(self._last(self._rows().drop("bucket")), f"base-{batches[-1].removeprefix('batch-')}")

    def sink(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start writing a stream into the collection."""
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(**trigger).start()
