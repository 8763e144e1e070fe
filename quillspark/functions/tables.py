"""Tables between the steps of a job, and rows numbered in groups of any size."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a table may have at most to be broadcast.
BROADCAST = 32 << 20


def shared_folder(spark) -> str:
    """The folder that the driver and all executors share; in local mode, as in tests, one of this machine if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/quillspark-scratch"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a short lineage that outlives lost executors.

    The written step is deleted when the driver's process ends; until then results may read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark, *paths: str) -> None:
    """Delete written steps that nothing will read again, and let go of the shuffle files of jobs that are done.

    Spark deletes the files of shuffles that nothing refers to when the driver collects its garbage.
    """
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def small(table: DataFrame, width: int, most: int = BROADCAST) -> DataFrame:
    """A table to be broadcast if its rows, counted, take `most` bytes at `width` each; else as it is, to be shuffled."""
    return F.broadcast(table) if table.count() * width <= most else table


#: Rows that a group may have at most to be sorted in one task.
GROUP = 1 << 18


def groups_fit(df: DataFrame, group: list[str], most: int = GROUP) -> bool:
    """Whether no group has over `most` rows: counted, each group at once in partial counts."""
    return bool(most) and (df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) <= most


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "number", most: int = GROUP, small_groups: bool | None = None) -> DataFrame:
    """df with the 1-based place of each row in its group.

    The groups' sizes are counted first, unless small_groups tells. If none has over `most` rows, each is sorted by
    itself. Else in two levels, so that no group is sorted in one task: rows are dealt into ranges of group and order;
    each range numbers its own, and counts by range give the offsets.
    """
    if groups_fit(df, group, most) if small_groups is None else small_groups:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(tasks, *group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    met = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(offsets, met)
    return out.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(name))


def numbered_wide(df: DataFrame, group: str, order: str, name: str = "number", rows: int = 8192) -> DataFrame:
    """df, whose rows are wide, with the 1-based place of each row in its group; each row moves once.

    Keys alone are numbered first: each rows-th of a group starts a range, and ranges are counted. Then rows go to
    their ranges, which are sorted each by itself, and come out in order there.
    """
    keys = cut(df.select(F.col(group).alias("_g"), F.col(order).alias("_o")))
    starts = numbered(keys, ["_g"], ["_o"], "_n").where(f"_n % {rows} = 0").groupBy("_g").agg(F.sort_array(F.collect_set("_o")).alias("_starts"))
    starts = small(cut(starts.withColumnRenamed("_g", "_s")), 8 * rows)

    def ranged(df: DataFrame, key: str, value: str) -> DataFrame:
        found = F.when(F.col("_starts").isNull(), 0).otherwise(F.size(F.filter("_starts", lambda x: x <= F.col(value))))
        return df.join(starts, F.col(key).eqNullSafe(F.col("_s")), "left").select(*df.columns, found.alias("_range"))

    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged(keys, "_g", "_o").groupBy("_g", "_range").agg(F.count("*").alias("_n")).withColumn("_offset", F.sum("_n").over(before))
    offsets = small(cut(counts.where("_range > 0").select("_g", F.col("_range").alias("_r"), "_offset")), 64)
    inside = ranged(df, group, order).withColumn("_inside", F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)))
    out = inside.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return out.select(*df.columns, (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_inside")).alias(name))


def running(df: DataFrame, group: list[str], order: list[str | Column], columns: dict[str, tuple[str, Column]], before: bool = False, most: int = GROUP, small_groups: bool | None = None) -> DataFrame:
    """df with running values of each group in order: name -> (how, what), how being sum, last or max; nulls don't count.

    The value is that of all rows so far, the row's own included, or with `before` that of the rows before it (null at
    the start). Groups are sorted by themselves if none has over `most` rows. Else rows are dealt into ranges of group
    and order, each range runs by itself from what the ranges before it amount to, and no group is sorted in one task.
    """
    make = {"sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True), "max": F.max}
    until = -1 if before else 0
    if groups_fit(df, group, most) if small_groups is None else small_groups:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
        return df.select("*", *[make[how](what).over(window).alias(name) for name, (how, what) in columns.items()])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(tasks, *group, *order).select("*", *[what.alias(f"_v{i}") for i, (_, what) in enumerate(columns.values())], F.spark_partition_id().alias("_range")))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    names = [(name, how, f"_v{i}") for i, (name, (how, _)) in enumerate(columns.items())]
    ends = ranged.select("*", F.row_number().over(inside).alias("_place")).groupBy(*group, "_range").agg(*[(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_place"))) if how == "last" else make[how](v)).alias(v) for _, how, v in names])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), *[make[how](v).over(earlier).alias(f"{v}_before") for _, how, v in names])
    met = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = ranged.select("*", *[make[how](v).over(inside.rowsBetween(Window.unboundedPreceding, until)).alias(f"{v}_here") for _, how, v in names]).join(ends, met)

    def joined(how: str, v: str) -> Column:
        here, old = F.col(f"{v}_here"), F.col(f"{v}_before")
        return F.coalesce(here + old, here, old) if how == "sum" else F.coalesce(here, old) if how == "last" else F.greatest(here, old)

    return rows.select(*df.columns, *[joined(how, v).alias(name) for name, how, v in names])
