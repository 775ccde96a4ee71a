"""Counters of a stream whose results are kept by key.

Every batch writes the keys that it changed, with their new values, to a folder of
its own; a batch that is run again replaces its folder. The state of a key is its row
of the last batch. ``compact`` writes the state of all keys as a new version, so that
readers need only the changes after it; changes are never deleted by readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from linkloom.operators import tables
from linkloom.sources.catalog import Versions


class Counters:
    """The results of ``counts`` (an aggregate of a stream) under ``root`` by ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = StructType([*schema.fields, StructField("batch", LongType())])
        self.states = Versions(spark, f"{self.root}/states")

    def save(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/changes/batch={number}")

    def start(self, counts: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        w = counts.writeStream.outputMode("update").foreachBatch(self.save).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()

    def changes(self) -> DataFrame:
        """All changed rows with their ``batch``."""
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/changes")

    def _state(self) -> DataFrame:
        rows = self.changes()
        if not self.states.empty():
            old = self.states.read()
            upto = old.agg(F.max("_upto")).first()[0]  # one number: the version holds the batches up to it
            rows = old.drop("_upto").unionByName(rows.where(F.col("batch") > (-1 if upto is None else upto)))
        return tables.last_by(rows, self.keys, "batch")

    def current(self) -> DataFrame:
        """One row a key: its last values."""
        return self._state().drop("batch")

    def compact(self) -> int:
        """Write the state of all keys as a new version; its number."""
        last = self.changes().agg(F.max("batch")).first()[0]
        return self.states.write(self._state().where(F.col("batch") <= F.lit(last)).withColumn("_upto", F.lit(last).cast("long")))
