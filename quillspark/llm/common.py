"""Shared helpers of the corpus operators: shared scratch tables, text batches and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a table may have at most to be broadcast.
BROADCAST = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    A session without such a folder gets one of this machine if it runs in local mode, as in tests, and else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quillspark-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, sweep: bool = True) -> DataFrame:
    """df written to a shared Parquet table and read again: cuts the lineage and outlives lost executors.

    sweep: shuffle files of plans that nothing refers to any more are deleted now, not whenever the driver's JVM
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the tables behind DataFrames of stored() that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(table: DataFrame, width: int, most: int = BROADCAST) -> DataFrame:
    """A stored table to be broadcast if its rows, counted, take `most` bytes at `width` each; else as it is, to be shuffled."""
    return F.broadcast(table) if table.count() * width <= most else table


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: what else df holds, whatever its names, plays no part."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def map_texts(df: DataFrame, function: Callable[[list, list], dict], schema: str, keys: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply function(keys, texts) to each Arrow batch; it gets lists, null texts as "", and returns columns of lists or arrays."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out = function(part.column(keys).to_pylist(), [t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(keys, text).mapInArrow(run, fields)


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Connected components of undirected links: rows (node, root), root being the smallest node reached.

    Alternates the large-star and small-star steps, each a grouped minimum and a join, until the links no longer
    change; a node with many links meets only its minimum, so no group is gathered. The minima are stored: they are
    broadcast if they measure small, and else both sides of the join are plain shuffles, which adaptive execution
    can split where a hub has many links. Nodes without links are absent. Rows with a null end are ignored. An empty
    input gives an empty result.
    """
    ends = edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
    links, before = stored(ends.where("a < b").distinct(), "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", False)
        large = both.join(small(least, 24), "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        large = stored(large, "large", False)
        discard(links, least)
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")), "least", False)
        met = large.join(small(least, 24), "b").select("m", F.explode(F.array("a", "b")).alias("v"))
        links = stored(met.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct(), "links", False)
        discard(large, least)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    heads = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(heads)
