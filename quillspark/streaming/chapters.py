"""Chapters as a stream: resumable, in order, each written once, with dictionary state that evolves by chapter."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.tables import numbered, shared_folder
from quillspark.operators import terms


def chapter_source(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of chapters in a folder, each file read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _written(spark: SparkSession, target: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(target)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_in_order(stream: DataFrame, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, limit: int | None = None):
    """Start a query that writes each novel's chapters in order, none twice and none past a gap or failure.

    Every micro-batch is joined to the next position of each novel: what is written is skipped, and of the others (and
    of those held back before) the run that goes on without a gap is written, up to `limit` new ones in a novel. `work`
    maps chapters to results with a column ok; the run ends before the first that is not ok. What waits and the next
    positions are kept in tables beside the target, one for each batch; the target is never read again. Each batch
    writes folders of its own and replaces them when it is run again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        held = _written(spark, f"{target}.waiting/{batch_id - 1}", schema)
        heads = _written(spark, f"{target}.next/{batch_id - 1}", T.StructType([schema["novel_id"], T.StructField("next", T.LongType())]))
        rows = batch.unionByName(held).dropDuplicates(["novel_id", "pos"]).join(heads, "novel_id", "left").withColumn("next", F.coalesce("next", F.lit(0).cast("long"))).where("pos >= next")
        ready = work(rows) if work else rows.withColumn("ok", F.lit(True))
        order = Window.partitionBy("novel_id").orderBy("pos")
        ready = ready.withColumn("k", F.row_number().over(order) - 1)
        good = (F.col("pos") == F.col("next") + F.col("k")) & F.col("ok") & (F.lit(limit is None) | (F.col("k") < F.lit(limit or 0)))
        ready = ready.withColumn("stop", F.sum((~good).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        ready.where("stop = 0").select(*schema.names).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        kept = ready.where("stop > 0").select("novel_id", "pos")
        rows.join(kept, ["novel_id", "pos"], "left_semi").select(*schema.names).write.mode("overwrite").parquet(f"{target}.waiting/{batch_id}")
        gone = spark.read.schema(schema).parquet(f"{target}/batch={batch_id}").select("novel_id", (F.col("pos") + 1).cast("long").alias("next"))
        heads.unionByName(gone).groupBy("novel_id").agg(F.max("next").alias("next")).write.mode("overwrite").parquet(f"{target}.next/{batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Usage(StatefulProcessor):
    """Counts and last places of terms by novel, purged as chapters pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getMapState("meta", "zh string", "last_seen long, count long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        uses = pd.concat(list(rows)).sort_values("pos")
        out = []
        for zh, pos in zip(uses["zh"], uses["pos"], strict=True):
            old = self.meta.getValue((zh,)) if self.meta.containsKey((zh,)) else None
            count = (old[1] if old else 0) + 1
            self.meta.updateValue((zh,), (int(pos), int(count)))
            out.append((key[0], zh, int(pos), int(count)))
        now = int(uses["pos"].max())
        for (zh,), (last, count) in list(self.meta.iterator()):
            if count == 1 and now - last > 100:
                self.meta.removeKey((zh,))
        yield pd.DataFrame(out, columns=["novel_id", "zh", "last_seen", "count"])

    def close(self) -> None:
        pass


def term_usage(stream: DataFrame) -> DataFrame:
    """(novel_id, zh, last_seen, count) updates from (novel_id, pos, zh); needs the RocksDB state store."""
    return stream.groupBy("novel_id").transformWithStateInPandas(statefulProcessor=_Usage(), outputStructType="novel_id string, zh string, last_seen long, count long", outputMode="Update", timeMode="None")


def spend(stream: DataFrame, group: str, cost: str) -> DataFrame:
    """Running cost by group, for complete output."""
    return stream.groupBy(group).agg(F.sum(cost).alias("spend"), F.count("*").alias("n"))


def progress(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def evolving_votes(stream_batch: DataFrame, memory: DataFrame) -> DataFrame:
    """Votes of a batch of (key, variant, pos) together with those remembered, folded in order."""
    return terms.vote(memory.unionByName(stream_batch), "key", "variant", ["pos"])


def settled(stream: DataFrame) -> DataFrame:
    """The result of an aggregation over a stream when all its input is read: each batch replaces the one before it."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{place}/out"))
    query.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def replay(chapters: DataFrame) -> DataFrame:
    """Chapters written to a folder, streamed in order by append_in_order(), and read back: (novel_id, n, last_pos)."""
    spark = chapters.sparkSession
    base = shared_folder(spark)
    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    ordered = numbered(chapters, ["novel_id"], ["pos"]).withColumn("pos", (F.col("number") - 1).cast("int")).drop("number")
    ordered.write.parquet(f"{place}/in")
    schema = ", ".join(f"{n} {t}" for n, t in ordered.dtypes)
    append_in_order(chapter_source(spark, f"{place}/in", schema), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("novel_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))
