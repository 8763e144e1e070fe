"""Chapters: parsing and writing chapter files, ordinals, first-seen dedup, prefixes and gaps. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import numbered, running, small

#: Fixed value: the line that ends a chapter.
RULE = "=" * 40
#: Shares that the rows of a zone are dealt into before the first draws of all are chosen.
SHARES = 64


def parse_chapters(files: DataFrame) -> DataFrame:
    """(novel_id, pos, title, paragraphs, is_title_entry) from (novel_id, value), value a whole chapter file.

    Lines are stripped; blank lines and rules are skipped; === title === starts a chapter; lines before the first
    header are dropped. Entry 0 without paragraphs is the novel's title.
    """
    lines = files.select("novel_id", F.posexplode(F.split("value", "\n", -1)).alias("line", "text")).withColumn("text", X.strip(F.col("text")))
    lines = lines.where((F.col("text") != "") & (F.col("text") != RULE)).withColumn("title", F.regexp_extract("text", r"^===(?U:\s*)(.*?)(?U:\s*)===$", 1)).withColumn("head", F.col("text").rlike(r"^===.*===$"))
    so_far = Window.partitionBy("novel_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("pos", F.sum(F.col("head").cast("int")).over(so_far) - 1).where("pos >= 0")
    chapters = lines.groupBy("novel_id", "pos").agg(F.min_by("title", "line").alias("title"), F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line", "text")))).alias("body"))
    chapters = chapters.select("novel_id", F.col("pos").cast("int").alias("pos"), "title", F.transform("body", lambda x: x["text"]).alias("paragraphs"))
    return chapters.withColumn("is_title_entry", (F.col("pos") == 0) & (F.size("paragraphs") == 0))


def content_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters without the title entry, numbered from 1 as source_index."""
    return numbered(chapters.where("NOT is_title_entry"), ["novel_id"], ["pos"], "source_index")


def completed(value: Column) -> Column:
    """Rules in a whole file; a missing file (null) has none."""
    return X.occurrences(F.coalesce(value, F.lit("")), F.lit(RULE))


def entry_text(title: Column, paragraphs: Column) -> Column:
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(p, F.lit("\n\n"))), "")
    return F.concat(F.lit("=== "), title, F.lit(" ===\n\n"), body, F.lit("\n" + RULE + "\n\n"))


def chapter_files(chapters: DataFrame, titled: str = "raw", size: int = 64) -> DataFrame:
    """(novel_id, part, value): the file of each novel in parts of `size` chapters, which follow one another from 0.

    A title entry is written without a rule in raw files and with one in translated files. Positions are numbered and
    parted without the paragraphs, which meet their part once; no task holds more than a part. Rows of one position
    stay together.
    """
    bare = F.col("is_title_entry") & F.lit(titled == "raw")
    entry = F.when(bare, F.concat(F.lit("=== "), F.col("title"), F.lit(" ===\n\n"))).otherwise(entry_text(F.col("title"), F.col("paragraphs")))
    places = numbered(chapters.select("novel_id", "pos").distinct(), ["novel_id"], ["pos"])
    places = places.select(F.col("novel_id").alias("_novel"), F.col("pos").alias("_pos"), F.floor((F.col("number") - 1) / size).alias("part"))
    placed = chapters.join(small(places, 64), F.col("novel_id").eqNullSafe(F.col("_novel")) & F.col("pos").eqNullSafe(F.col("_pos")))
    parts = placed.groupBy("novel_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("parts"))
    return parts.select("novel_id", "part", F.array_join(F.transform("parts", lambda x: x["entry"]), "").alias("value"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order: a minimum for each key, joined back, so that copies meet as partials."""
    heads = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_head"))
    here = F.lit(True)
    for c in keys:
        here = here & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return df.alias("l").join(heads.alias("r"), here & (F.struct(*[F.col(f"l.{c}") for c in order]) == F.col("r._head"))).select("l.*")


def unique_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters whose title and paragraphs have not occurred before in the novel."""
    return first_seen(chapters.withColumn("_hash", X.content_hash(F.col("title"), F.col("paragraphs"))), ["novel_id", "_hash"], ["pos"]).drop("_hash")


def gaps(df: DataFrame, group: list[str], place: str) -> DataFrame:
    """Rows whose place is not one more than the place before it in their group (the first must be 1)."""
    rows = running(df, group, [place], {"_before": ("last", F.col(place))}, before=True)
    return rows.withColumn("expected", F.coalesce("_before", F.lit(0)) + 1).where(F.col(place) != F.col("expected")).drop("_before")


def contiguous_prefix(df: DataFrame, group: list[str], place: str, present: Column) -> DataFrame:
    """Rows before the first row of the group that is not present."""
    return running(df, group, [place], {"_missing": ("sum", (~present).cast("int"))}).where("_missing = 0").drop("_missing")


def carried_number(df: DataFrame, group: list[str], place: str, number: Column, name: str = "carried") -> DataFrame:
    """df with the last number so far in the group, 0 before the first."""
    return running(df, group, [place], {"_carried": ("last", number.cast("long"))}).withColumn(name, F.coalesce("_carried", F.lit(0).cast("long"))).drop("_carried")


def labels(chapters: DataFrame) -> DataFrame:
    """A label for each chapter: its own number if at least half of the titles have one, else its ordinal.

    Novels are counted and their places numbered without the chapters' texts; rows of one place have one ordinal.
    """
    number = X.chapter_number(F.col("title"))
    keys = chapters.select(F.col("novel_id").alias("_novel"), F.col("pos").alias("_pos"), number.alias("_number"))
    most = keys.groupBy("_novel").agg((F.count("_number") * 2 >= F.count("*")).alias("_most"))
    places = numbered(keys.select("_novel", "_pos").distinct(), ["_novel"], ["_pos"], "_ordinal")
    table = places.join(most.select(F.col("_novel").alias("_of"), "_most"), F.col("_novel").eqNullSafe(F.col("_of"))).drop("_of")
    met = chapters.join(table, F.col("novel_id").eqNullSafe(F.col("_novel")) & F.col("pos").eqNullSafe(F.col("_pos")))
    return met.select(*[F.col(c) for c in chapters.columns], F.when(F.col("_most"), number).otherwise(F.col("_ordinal").cast("long")).alias("label"))


def batches(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """batch: rows of a group in runs of `size`."""
    placed = numbered(df, group, order, "_number")
    return placed.withColumn("batch", F.floor((F.col("_number") - 1) / size)).drop("_number")


def style_sample(chapters: DataFrame, k: int = 5, seed: str = "style") -> DataFrame:
    """Up to k chapters of each novel, at least one of each of its first, middle and last fifth, by a seeded hash."""
    rows = chapters.where(F.size("paragraphs") > 0)
    sizes = rows.groupBy("novel_id").agg(F.count("*").alias("n"))
    rows = numbered(rows.select("novel_id", "pos"), ["novel_id"], ["pos"]).withColumn("i", F.col("number") - 1).drop("number").join(small(sizes, 64), "novel_id")
    z, half = F.greatest(F.lit(1), F.floor(F.col("n") / 5)), F.floor(F.col("n") / 2)
    mid_low, mid_high = F.greatest(z, half - z), F.least(F.col("n") - z, half + z)
    zone = F.when(F.col("i") < z, "first").when(F.col("i").between(mid_low, mid_high - 1), "mid").when(F.col("i") >= F.greatest(mid_high, F.col("n") - z), "last").otherwise("rest")
    rows = rows.withColumn("zone", zone).withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), "novel_id", "pos").cast("binary")))
    # Only the k first draws of each zone can be chosen: shares of a zone give theirs, and those meet by novel.
    share = F.row_number().over(Window.partitionBy("novel_id", "zone", F.pmod(F.xxhash64("pos"), F.lit(SHARES))).orderBy("draw"))
    rows = rows.withColumn("_share", share).where(F.col("_share") <= k)
    in_zone = F.row_number().over(Window.partitionBy("novel_id", "zone").orderBy("draw"))
    rows = rows.withColumn("wanted", (F.col("zone") != "rest") & (in_zone <= max(1, k // 3)))
    rank = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("wanted"), "draw"))
    picked = rows.withColumn("rank", rank).where((F.col("rank") <= k) | (F.col("n") <= 5)).select("novel_id", "pos", "zone")
    return chapters.join(small(picked, 64), ["novel_id", "pos"])
