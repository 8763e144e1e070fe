"""Keyed state that outlives a run: glossaries, their metadata, idiom memories, caches of results, last URLs.

A state is a folder of numbered versions, each a Parquet table of changes. What is not committed, or cannot be read, is
as if it were not there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a version does: sets rows, removes keys, or starts anew from its rows.
SET, GONE, WHOLE = "set", "gone", "whole"
#: Versions after which a change is followed by a compaction.
MOST = 16


class KeyedState:
    """The rows of a state by key; each change is a version of its own, and the last change of a key counts.

    One run at a time writes a state. Keys and other columns may be null. Of rows alike in key within one change, the
    greatest counts. A version is there once Spark has committed it; files that are broken are left out when it is
    read, so the state goes back to what the others hold.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str]) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[tuple[int, str]]:
        """(number, kind) of all committed versions, from the last that starts anew."""
        path, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        found = sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if "-" in n and files.exists(self._path(f"{n}/_SUCCESS")))
        whole = max((i for i, (_, kind) in enumerate(found) if kind == WHOLE), default=0)
        return found[whole:]

    def load(self) -> DataFrame:
        """The rows as they stand; an absent state is empty."""
        parts = [self._read(number, kind) for number, kind in self.versions()]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts)
        order = F.struct("_version", F.to_json(F.struct(*self.schema.names)))
        last = rows.groupBy(*[F.col(k) for k in self.keys]).agg(F.max_by(F.struct("_kind", F.struct(*self.schema.names).alias("row")), order).alias("_last"))
        return last.where(F.col("_last._kind") != GONE).select("_last.row.*")

    def _read(self, number: int, kind: str) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").parquet(f"{self.folder}/{number:08d}-{kind}")
        return rows.withColumns({"_version": F.lit(number), "_kind": F.lit(kind)})

    def _write(self, rows: DataFrame, kind: str) -> None:
        path, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        number = max((int(n.split("-")[0]) for n in names if "-" in n), default=0) + 1
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/{number:08d}-{kind}")

    def upsert(self, rows: DataFrame) -> None:
        """Set these rows, new ones and those whose keys are there."""
        self._write(rows.select(*self.schema.names), SET)
        self._tidy()

    def delete(self, keys: DataFrame) -> None:
        """Remove these keys; those that are absent don't matter."""
        columns = [F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self._write(keys.select(*columns), GONE)
        self._tidy()

    def clear(self) -> None:
        """Remove everything."""
        self._write(self.spark.createDataFrame([], self.schema), WHOLE)
        self._drop()

    def compact(self) -> None:
        """One version in place of all."""
        self._write(self.load(), WHOLE)
        self._drop()

    def _tidy(self) -> None:
        if len(self.versions()) > MOST:
            self.compact()

    def _drop(self) -> None:
        """Delete the versions before the last that starts anew, committed or not."""
        path, files = self._files()
        first = self.versions()[0][0]
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if "-" in name and int(name.split("-")[0]) < first:
                files.delete(status.getPath(), True)


def glossary(spark: SparkSession, folder: str) -> KeyedState:
    """Terms of a novel and their uses."""
    return KeyedState(spark, folder, "novel_id string, zh string, vi string, ord long, last_seen long, count long", ["novel_id", "zh"])


def results(spark: SparkSession, folder: str) -> KeyedState:
    """Results by chapter, kept until the chapter is written; operators.heal.cached_result() tells which still fit."""
    return KeyedState(spark, folder, "novel_id string, pos long, title string, paragraphs array<string>, source_hash string", ["novel_id", "pos"])


def progress(spark: SparkSession, folder: str) -> KeyedState:
    """The last URL and title of each book that is crawled."""
    return KeyedState(spark, folder, "book_id string, last_url string, last_title string, existing long", ["book_id"])
