"""Healing of novels: copies out, order by chapter number, translations kept as a prefix and a stash."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X
from quillspark.functions.tables import cut, groups_fit, numbered, running, small

#: Likeness of near copies, and how far paragraph counts of pairs may differ.
RATIO, PARAGRAPHS = 0.97, 3


#: Texts of a block that a round settles among themselves before the rest of the block is held against those it keeps.
HEADS = 64
#: Bytes that a text's character counts take at about.
COUNTS = 4096
#: Texts of a tile of near_pairs(), bins of characters that are compared first, and entries of counts compared at once.
TILE, BINS, ENTRIES = 1024, 32, 1 << 22


def character_counts(text: Column) -> Column:
    """How often each character occurs in a text, as a map."""
    chars = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.struct(c.alias("c"), X.occurrences(text, c).alias("m")))
    return F.map_from_entries(F.filter(chars, lambda x: x["c"] != ""))


def likeness(one: Column, two: Column, sizes: Column) -> Column:
    """Twice the characters that two maps of counts share by both lengths together."""
    return 2 * F.aggregate(F.map_entries(one), F.lit(0).cast("long"), lambda s, x: s + F.least(x["value"], F.coalesce(F.try_element_at(two, x["key"]), F.lit(0).cast("long")))) / sizes


@F.arrow_udf(T.BinaryType())
def packed_counts(text: pa.Array) -> pa.Array:
    """The characters of each text in order, then how often each occurs, all as 32-bit numbers."""

    def packed(t: str) -> bytes:
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        if len(codes) and codes.max() < 1 << 16:
            counts = np.bincount(codes)
            kinds = np.flatnonzero(counts)
            counts = counts[kinds]
        else:
            kinds, counts = np.unique(codes, return_counts=True)
        return np.r_[kinds, counts].astype(np.uint32).tobytes()

    return pa.array([packed(t.as_py() or "") for t in text], pa.binary())


def _alike(counts: list[bytes], block: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `one` and of `two` of equal block that are alike, and their ratios; of one tile, pairs count once.

    Rows are sorted by block and length n, so a row meets a run of `two`. Counts in BINS bins share at least what whole
    counts share, so no pair is lost by them; whole counts decide.
    """
    packed = [np.frombuffer(c, np.uint32).reshape(2, -1) for c in counts]
    sizes = np.array([p.shape[1] for p in packed])
    kinds, many = np.concatenate(packed, axis=1).astype(np.int64)
    starts, rows = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    bins = np.bincount(rows * BINS + kinds % BINS, many, BINS * len(sizes)).astype(np.int32).reshape(-1, BINS).T
    theirs, sizes_two = np.ascontiguousarray(bins[:, two]), n[two]
    places, far = block[two] << 40 | sizes_two, 2 / ratio - 1
    low = np.searchsorted(places, block[one] << 40 | np.maximum(0, np.floor(n[one] / far).astype(np.int64) - 1))
    high = np.searchsorted(places, block[one] << 40 | np.ceil(n[one] * far).astype(np.int64) + 1, "right")
    if one is two:
        low = np.maximum(low, np.arange(len(one)) + 1)
    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, lo, hi in zip(one.tolist(), low.tolist(), high.tolist(), strict=True):
        if lo < hi:
            most = np.minimum(theirs[:, lo:hi], bins[:, x : x + 1]).sum(axis=0, dtype=np.int64)
            near = two[lo:hi][2 * most / (n[x] + sizes_two[lo:hi]) >= ratio]
            at.append(np.full(len(near), x))
            to.append(near)
    at, to = np.concatenate(at), np.concatenate(to)
    marks, shared = rows << 32 | kinds, np.zeros(len(at), np.int64)
    ends = np.cumsum(sizes[at])
    for part in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(ENTRIES, ends[-1], ENTRIES), "right") if len(ends) else []):
        own = sizes[at[part]]
        pair = np.repeat(np.arange(len(part)), own)
        here = np.arange(len(pair)) + np.repeat(starts[at[part]] - np.cumsum(own) + own, own)
        mark = to[part][pair] << 32 | kinds[here]
        spot = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
        shared[part] = np.bincount(pair, np.where(marks[spot] == mark, np.minimum(many[here], many[spot]), 0), len(part)).astype(np.int64)
    ratios = 2 * shared / (n[at] + n[to])
    sure = ratios >= ratio
    return at[sure], to[sure], ratios[sure]


def near_pairs(df: DataFrame, block: list[str], key: str, text: str, ratio: float = RATIO) -> DataFrame:
    """(key_a, key_b, ratio) for distinct texts of a block that share at least `ratio` of their characters.

    The ratio is twice the shared characters, counted with repeats, by both lengths. Copies meet once; null blocks and
    keys take no part. All pairs are listed: for large blocks see near_keepers().

    Texts are sorted by block and length and dealt into tiles of TILE rows. Lengths bound the ratio, so a tile meets
    itself and those that begin within the reach of its last text; no task holds more than two tiles.
    """
    rows = df.select(*block, F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    for c in (*block, "_k"):
        rows = rows.where(F.col(c).isNotNull())
    # Blocks of one row are left out by a hash: a block that shares one with another only stays in longer.
    rows = rows.withColumn("_h", F.xxhash64(*block))
    crowded = cut(rows.groupBy("_h").agg(F.count("*").alias("_m")).where("_m > 1").select("_h"))
    rows = rows.join(small(crowded, 16), "_h", "left_semi").select(*block, "_k", F.length("_t").cast("long").alias("_n"), F.sha2("_t", 256).alias("_d"), packed_counts("_t").alias("_counts"))
    texts = rows.groupBy(*block, "_d").agg(F.min("_k").alias("_k"), F.first("_n").alias("_n"), F.first("_counts").alias("_counts"))
    texts = cut(texts.drop("_d").withColumn("_b", F.sha2(F.to_json(F.struct(*block)), 256)))
    order, tasks = ["_b", "_n", "_k"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.repartitionByRange(max(1, min(tasks, texts.count() // (4 * TILE))), *order).withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    tiled = cut(ranged.withColumn("_tile", F.struct("_range", F.floor((place - 1) / TILE).alias("_place"))).drop("_range"))
    ends = tiled.groupBy("_tile").agg(F.min(F.struct("_b", "_n")).alias("_first"), F.max(F.struct("_b", "_n")).alias("_last"))
    ends = cut(ends)
    one, two = ends.select(F.col("_tile").alias("_one"), F.col("_last._b").alias("_b"), F.col("_last._n").alias("_n1")), ends.select(F.col("_tile").alias("_two"), F.col("_first._b").alias("_b"), F.col("_first._n").alias("_n2"))
    met = one.join(two, "_b").where((F.col("_one") < F.col("_two")) & (2 * F.col("_n1") + 1 >= ratio * (F.col("_n1") + F.col("_n2")))).select("_one", "_two")
    met = cut(met.unionByName(ends.select(F.col("_tile").alias("_one"), F.col("_tile").alias("_two"))))
    sides = met.select("_one", "_two", F.posexplode(F.array_distinct(F.array("_one", "_two"))).alias("_side", "_tile"))
    kind = texts.schema["_k"].dataType
    schema = T.StructType([*[texts.schema[c] for c in block], T.StructField("_x", kind), T.StructField("_y", kind), T.StructField("ratio", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        codes = table.column("_b").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        n = table.column("_n").to_numpy()
        by = np.lexsort((n, codes))
        table, side = table.take(by), table.column("_side").to_numpy()[by]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        at, to, ratios = _alike([c.as_py() for c in table.column("_counts")], codes[by], n[by], first, second if len(second) else first, ratio)
        return pa.Table.from_arrays([*[table.column(c).take(at) for c in block], table.column("_k").take(at), table.column("_k").take(to), pa.array(ratios)], names=schema.names)

    cells = tiled.join(small(sides, 64), "_tile").select("_one", "_two", "_side", *block, "_b", "_n", "_k", "_counts")
    found = cells.groupBy("_one", "_two").applyInArrow(run, schema).where("_x <> _y")
    return found.select(*block, F.least("_x", "_y").alias("key_a"), F.greatest("_x", "_y").alias("key_b"), "ratio")


def near_keepers(df: DataFrame, block: list[str], key: str, text: str, ratio: float = RATIO, count: str | None = None) -> DataFrame:
    """(block, key, keeper) of each distinct text of a block (its least key): the first kept text that it is nearly like.

    In the order of keys a text is kept unless it is nearly like one that is kept before it, which then is its keeper;
    a text nearly like a copy alone is kept. Keepers are their own. Alike is as in near_pairs(); with `count`, these
    numbers must also differ by PARAGRAPHS at most. Empty texts and null blocks take no part.

    Each round settles the first HEADS open texts of every block among themselves and holds the block's others against
    those that are kept, so that no pairs of copies are made: a block of any number of copies of few texts takes a
    round of linear work. Rounds are as many as the most texts kept in a block by HEADS.
    """
    rows = df.select(*block, F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(count) if count else F.lit(0)).alias("_c")).where(F.length("_t") > 0)
    rows = rows.groupBy(*block, "_t").agg(F.min(F.struct("_k", "_c")).alias("_f"))
    rows = cut(rows.select(*block, F.col("_f._k").alias("_k"), F.col("_f._c").alias("_c"), F.length("_t").alias("_n"), character_counts(F.col("_t")).alias("_hist")))
    crowded = cut(rows.groupBy(*block).agg(F.count("*").alias("_m")).where("_m > 1").drop("_m"))
    settled = [rows.join(crowded, block, "left_anti").select(*block, F.col("_k").alias("key"), F.col("_k").alias("keeper"))]
    open_ = rows.join(crowded, block, "left_semi")

    def alike(one: str, two: str) -> Column:
        n = F.col(f"{one}._n") + F.col(f"{two}._n")
        bound = F.least(f"{one}._n", f"{two}._n") * 2 >= F.lit(ratio) * n
        near = F.when(bound, likeness(F.col(f"{one}._hist"), F.col(f"{two}._hist"), n) >= ratio).otherwise(False)
        return near & (F.abs(F.col(f"{one}._c") - F.col(f"{two}._c")) <= PARAGRAPHS)

    whole = F.struct("_k", "_c", "_n", "_hist")
    share = Window.partitionBy(*block, F.pmod(F.xxhash64("_k"), F.lit(HEADS))).orderBy("_k")
    while not open_.isEmpty():
        heads = open_.select(*block, "_k").withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= HEADS)
        heads = heads.withColumn("_r", F.row_number().over(Window.partitionBy(*block).orderBy("_k"))).where(F.col("_r") <= HEADS)
        heads = cut(open_.join(small(heads.drop("_r"), 64), [*block, "_k"]).select(*block, whole.alias("_two")))
        before = heads.join(heads.withColumnRenamed("_two", "_one"), block).where((F.col("_one._k") < F.col("_two._k")) & alike("_one", "_two")).groupBy(*block, F.col("_two._k").alias("_k")).agg(F.collect_set("_one._k").alias("_near"))
        chain = heads.select(*block, "_two._k").join(before, [*block, "_k"], "left").groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("_k", "_near"))).alias("_h"))
        first = F.slice(F.transform("_h", lambda h: h["_k"]), 1, 1)
        kept = F.aggregate(F.slice("_h", 2, HEADS), first, lambda s, h: F.when(F.coalesce(F.arrays_overlap(s, h["_near"]), F.lit(False)), s).otherwise(F.concat(s, F.array(h["_k"]))))
        kept = chain.select(*block, F.explode(kept).alias("_k"))
        kept = cut(heads.withColumn("_k", F.col("_two._k")).join(kept, [*block, "_k"], "left_semi").select(*block, F.col("_two").alias("_one")))
        others = open_.join(heads.select(*block, "_two._k"), [*block, "_k"], "left_anti").unionByName(heads.select(*block, "_two.*").join(kept.select(*block, "_one._k"), [*block, "_k"], "left_anti"))
        found = others.select(*block, whole.alias("_two")).join(small(kept, COUNTS), block).where(alike("_one", "_two")).groupBy(*block, F.col("_two._k").alias("key")).agg(F.min("_one._k").alias("keeper"))
        found = cut(found)
        settled += [kept.select(*block, F.col("_one._k").alias("key"), F.col("_one._k").alias("keeper")), found]
        done = found.select(*block, F.col("key").alias("_k")).unionByName(kept.select(*block, "_one._k"))
        open_ = cut(open_.join(done, [*block, "_k"], "left_anti"))
    return reduce(DataFrame.unionByName, settled)


def paired(raw: Column, translated: Column) -> Column:
    """Whether paragraph counts fit: they differ by 3 or a tenth of the first at most."""
    return F.abs(raw - translated) <= F.greatest(F.lit(PARAGRAPHS), F.floor(raw / 10))


def heal(raw: DataFrame, translated: DataFrame) -> dict[str, DataFrame]:
    """raw, translated, stash, places and summary of all novels, from (novel_id, pos, title, paragraphs) without title entries.

    A novel whose translation does not fit its raw chapters is left alone. Chapters equal in title and paragraphs, or
    of one numbered title and nearly alike a chapter that is kept, are one; a translation of any copy is kept. Chapters are sorted by number if
    numbers are not repeated and at least half have one; others follow the numbered chapter before them. Translations
    up to the first gap stay in place, later ones go to the stash by content hash. places has the old and new place of
    each chapter that stays, its number and its hash.
    """
    # All is settled on keys; titles, paragraphs and translations are read again for what stays, and bodies before that
    # only for chapters that share a numbered title with others of their novel.
    theirs = translated.select("novel_id", "pos", F.size("paragraphs").alias("done_size"), F.lit(True).alias("there"))
    ours = raw.select("novel_id", "pos", F.size("paragraphs").alias("size"), X.content_hash(F.col("title"), F.col("paragraphs")).alias("hash"), X.chapter_number(F.col("title")).alias("number"), F.sha2("title", 256).alias("named"))
    rows = cut(ours.join(theirs, ["novel_id", "pos"], "left"))
    extra = theirs.join(rows.select("novel_id", "pos"), ["novel_id", "pos"], "left_anti").select("novel_id", F.lit(False).alias("fits"))
    checks = rows.select("novel_id", F.coalesce(paired(F.col("size"), F.col("done_size")), F.lit(True)).alias("fits")).unionByName(extra)
    fits = checks.groupBy("novel_id").agg(F.min("fits").alias("fits"))
    exact = rows.groupBy("novel_id", "hash").agg(F.min("pos").alias("keeper"))
    rows = cut(rows.join(fits, "novel_id").join(exact, ["novel_id", "hash"]))
    heads = rows.where("pos = keeper AND number IS NOT NULL").select("novel_id", "named", "pos")
    shared = heads.groupBy("novel_id", "named").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    heads = cut(heads.join(shared, ["novel_id", "named"], "left_semi"))
    bodies = raw.join(small(heads, 128), ["novel_id", "pos"]).select("novel_id", "named", "pos", F.array_join("paragraphs", "\n").alias("body"), F.size("paragraphs").alias("size"))
    near = near_keepers(bodies, ["novel_id", "named"], "pos", "body", count="size").select("novel_id", F.col("key").alias("keeper"), F.col("keeper").alias("older"))
    rows = rows.join(near, ["novel_id", "keeper"], "left").withColumn("keeper", F.when(F.col("fits"), F.coalesce("older", "keeper")).otherwise(F.col("pos"))).drop("older")
    done = rows.where("there").groupBy("novel_id", "keeper").agg(F.min("pos").alias("done_pos")).withColumnRenamed("keeper", "pos")
    kept = rows.where("pos = keeper").select("novel_id", "pos", "fits", "number", "hash").join(done, ["novel_id", "pos"], "left")
    keys = cut(kept.withColumn("open", F.col("done_pos").isNull().cast("int")))
    small_groups = groups_fit(keys, ["novel_id"])
    sortable = keys.groupBy("novel_id").agg((F.min("fits") & (F.count("number") == F.count_distinct("number")) & (F.count("number") > 0) & (F.count("number") * 2 >= F.count("*"))).alias("sortable"))
    keys = running(keys, ["novel_id"], ["pos"], {"carried": ("last", F.col("number"))}, small_groups=small_groups)
    keys = numbered(keys, ["novel_id"], ["pos"], "old_rank", small_groups=small_groups).join(sortable, "novel_id")
    keys = keys.withColumn("place", F.when(F.col("sortable"), F.coalesce("carried", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    keys = numbered(keys, ["novel_id"], ["place", "pos"], "new_pos", small_groups=small_groups)
    keys = running(keys, ["novel_id"], ["place", "pos"], {"gap": ("sum", F.col("open"))}, small_groups=small_groups).withColumns({"new_pos": F.col("new_pos") - 1, "old_rank": F.col("old_rank") - 1})
    keys = cut(keys.select("novel_id", "pos", "hash", "done_pos", F.col("new_pos").cast("int").alias("new_pos"), "old_rank", "gap", "number"))
    stays = small(keys.select("novel_id", "pos", "new_pos"), 64)
    placed = translated.join(small(keys.where("done_pos IS NOT NULL").select("novel_id", F.col("done_pos").alias("pos"), "new_pos", "hash", "gap"), 128), ["novel_id", "pos"])
    counts = keys.groupBy("novel_id").agg(F.count("*").alias("total"), F.sum((F.col("gap") == 0).cast("int")).alias("translated"), F.sum(((F.col("gap") > 0) & F.col("done_pos").isNotNull()).cast("int")).alias("stashed"), F.sum((F.col("new_pos") != F.col("old_rank")).cast("int")).alias("moved"))
    before = raw.groupBy("novel_id").agg(F.count("*").alias("before"))
    summary = counts.join(before, "novel_id").select("novel_id", ((F.col("before") > F.col("total")) | (F.col("moved") > 0)).alias("fixed"), "total", "translated", "stashed", F.greatest(F.lit(0), F.col("total") - F.col("translated") - F.col("stashed")).alias("todo"), (F.col("before") - F.col("total")).alias("duplicates"), "moved")
    return {
        "raw": raw.join(stays, ["novel_id", "pos"]).select("novel_id", F.col("new_pos").alias("pos"), "title", "paragraphs"),
        "translated": placed.where("gap = 0").select("novel_id", F.col("new_pos").alias("pos"), "title", "paragraphs"),
        "stash": placed.where("gap > 0").select("novel_id", "hash", "title", "paragraphs"), "summary": summary,
        "places": keys.select("novel_id", "pos", "new_pos", "number", "hash"),
    }


def take_stashed(stash: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stashed rows whose hash is wanted, and the rows that remain: each is used up once."""
    return stash.join(wanted.select("hash"), "hash", "left_semi"), stash.join(wanted.select("hash"), "hash", "left_anti")


def cached_result(chapters: DataFrame, cache: DataFrame) -> DataFrame:
    """hit: whether a cached result still fits its chapter (hash absent or equal, as many paragraphs, no CJK left)."""
    joined = chapters.join(cache.select("novel_id", "pos", F.col("paragraphs").alias("c_paragraphs"), F.col("source_hash").alias("c_hash")), ["novel_id", "pos"], "left")
    same = F.col("c_hash").isNull() | (F.col("c_hash") == X.content_hash(F.col("title"), F.col("paragraphs")))
    return joined.withColumn("hit", F.coalesce(F.col("c_paragraphs").isNotNull() & same & (F.size("c_paragraphs") == F.size("paragraphs")) & ~X.has_script(F.array_join("c_paragraphs", "\n")), F.lit(False)))


def union_by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables, one for each key: a later table wins."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("priority", F.lit(i)) for i, t in enumerate(tables)])
    top = ranked.groupBy(key).agg(F.max("priority").alias("priority"))
    return ranked.join(top, [key, "priority"])
