"""Audit of how document filters interact: every order of five filters, replayed on every document."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, small, stored

#: The filters by letter; each is a bit of a document's flags.
FILTERS = "ABCDE"
#: Fixed values of the conditions: least words, least percentage of distinct words, most percentage of capitals, symbols.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: Documents that a task replays; each makes a row for every order and step.
SHARE = 8192
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_flags(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a null text is empty.

    A: under 100 words. B: distinct words below 80 % of the words. C: capitals A-Z over 10 % of the code points. D:
    any of the symbols. An empty text fails A alone.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    fails = [
        F.size(words) < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * CAPITALS, text.rlike(SYMBOLS),
    ]
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, flags, good, toxic), one row for each document: the bits of the filters that it fails, and its labels.

    E: the text is identical to that of a row with a smaller key anywhere in the table. Texts are compared by SHA-256,
    so that only digests are shuffled. A row without a key comes after all others: it fails E if any row with a key
    has its text. Rows alike in key and text do not fail E on account of one another. Several labels of a key count
    as one that has what any of them has; a key without labels, and a null key, is neither good nor toxic.

    A text that a third of all rows hold is one digest: its minimum is taken from partial minima. The minima of digests
    that occur more than once are stored and broadcast if they measure small; else the join back is of two plain
    shuffles of narrow rows, which adaptive execution splits.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_flags(F.col(text)).alias("flags"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))
    rows = stored(rows, "flags")
    first = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first")
    first = small(stored(first, "first"), 96)
    copy = F.coalesce(F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first"))), F.lit(False))
    rows = rows.join(first, F.col("digest") == F.col("of"), "left").select("key", "part", (F.col("flags") + F.when(copy, 1 << 4).otherwise(0)).alias("flags"))
    marks = labels.groupBy(F.col("doc_id").alias("_key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, F.col("key") == F.col("_key"), "left")
    return rows.select("part", "flags", *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, bits): every order of the filters, 120 rows for five, and the bits of its filters from left to right."""
    rows = [F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << filters.index(x)) for x in p]).alias("bits")) for p in permutations(filters)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def replay(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step: documents kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    rows(part, flags, good, toxic), as of flagged(). Every document meets the broadcast orders, whose number is fixed;
    the first step at which it fails is found once for each order, the steps are exploded, and sums conditional on that
    step are combined in each task before the shuffle. What is shuffled is a row for each part, order, step and task.
    An empty table has no parts and gives no rows; a part whose documents all pass gives zeros.
    """
    steps = len(filters)
    met = rows.crossJoin(F.broadcast(orders(rows.sparkSession, filters)))
    first = F.lit(steps + 1)
    for step in range(steps, 0, -1):
        first = F.when(F.col("flags").bitwiseAND(F.col("bits")[step - 1]) != 0, step).otherwise(first)
    met = met.select("part", "filter_order", "flags", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    removed = F.col("first") == step
    sums = {
        "kept": F.col("first") > step, "removed": removed, "redundant": (F.col("first") < step) & (F.col("flags").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("flags") == F.col("bit"), "good_lost": removed & (F.col("good") == 1), "toxic_lost": removed & (F.col("toxic") == 1),
    }
    counts = met.groupBy("part", "filter_order", "at").agg(*[F.count_if(condition).alias(name) for name, condition in sums.items()])
    counts = stored(counts.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), *COUNTS), "replay")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    by_filter = counts.groupBy(F.col("part").alias("_part"), letter.alias("_filter")).agg(F.sum("removed").alias("shapley"))
    return counts.join(by_filter, (F.col("part") == F.col("_part")) & (letter == F.col("_filter"))).drop("_part", "_filter")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """replay() of flagged(): one row for each value of the part column (null as ""), order of the filters and step.

    The narrow rows are dealt out by number before they are replayed: by their bytes, a task would have millions.
    """
    rows = stored(flagged(docs, labels, key, text, part), "audit")
    return replay(rows.repartition(max(1, -(-rows.count() // SHARE))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all 120 orders, by language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: DuckDB SQL for op13_filter_audit: the same counts from every document, order and step.
ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
  (CASE WHEN len(words) < {LEAST_WORDS} THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT} * len(words) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(w.t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(w.t, '{SYMBOLS}') THEN 'D' ELSE '' END)
  || (CASE WHEN e.first IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > e.first) THEN 'E' ELSE '' END) AS fails
  FROM w JOIN e ON w.t = e.t LEFT JOIN m ON w.doc_id = m.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
f AS (SELECT d.*, filter_order, coalesce(list_min(list_filter([CASE WHEN contains(fails, filter_order[i]) THEN i END FOR i IN range(1, 6)], lambda x: x IS NOT NULL)), 6) AS first FROM d, o),
c AS (SELECT part, s.filter_order, step, s.f, count_if(first > step)::BIGINT AS kept, count_if(first = step)::BIGINT AS removed, count_if(first < step AND contains(fails, s.f))::BIGINT AS redundant,
  count_if(fails = s.f)::BIGINT AS unique_fails, count_if(first = step AND good = 1)::BIGINT AS good_lost, count_if(first = step AND toxic = 1)::BIGINT AS toxic_lost
  FROM f JOIN s ON f.filter_order = s.filter_order GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM c
"""
