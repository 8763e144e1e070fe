"""Validation of translations against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X


def gate(source: Column, target: Column, script: str = X.CJK) -> Column:
    """Why a translated chapter is refused (paragraphs, script), or ok."""
    return sized_gate(F.size(source), target, script)


def sized_gate(size: Column, target: Column, script: str = X.CJK) -> Column:
    """gate() of a chapter that has `size` paragraphs."""
    return F.when(size != F.size(target), "paragraphs").when(X.has_script(F.array_join(target, "\n"), script), "script").otherwise("ok")


def report(raw: DataFrame, translated: DataFrame, script: str = X.CJK) -> DataFrame:
    """(novel_id, chapter, rule, n): empty chapters, differing paragraph counts, foreign characters, differing totals.

    Inputs are (novel_id, pos, title, paragraphs) without title entries, pos from 0. An empty chapter has no other
    warnings; blank paragraphs do not count. chapter is null for totals.
    """
    full = F.filter("paragraphs", lambda p: X.filled(F.coalesce(p, F.lit(""))))
    ours = translated.select("novel_id", "pos", full.alias("t"))
    theirs = raw.select("novel_id", "pos", F.size(full).alias("r"))
    both = ours.join(theirs, ["novel_id", "pos"], "left").withColumn("n", F.size("t"))
    left = F.regexp_count(F.array_join("t", "\n"), F.lit(f"[{script}]"))
    rules = F.filter(
        F.array(
            F.when(F.col("n") == 0, F.struct(F.lit("empty").alias("rule"), F.lit(0).alias("n"))),
            F.when((F.col("n") > 0) & (F.col("n") != F.col("r")), F.struct(F.lit("paragraphs").alias("rule"), (F.col("n") - F.col("r")).alias("n"))),
            F.when((F.col("n") > 0) & (left > 0), F.struct(F.lit("script").alias("rule"), left.cast("int").alias("n"))),
        ),
        lambda x: x.isNotNull(),
    )
    found = both.select("novel_id", (F.col("pos") + 1).alias("chapter"), F.explode(rules).alias("x")).select("novel_id", "chapter", "x.rule", "x.n")
    sizes = translated.groupBy("novel_id").agg(F.count("*").alias("t")).join(raw.groupBy("novel_id").agg(F.count("*").alias("r")), "novel_id", "full")
    totals = sizes.withColumn("n", (F.coalesce("t", F.lit(0)) - F.coalesce("r", F.lit(0))).cast("int")).where("n != 0").select("novel_id", F.lit(None).cast("int").alias("chapter"), F.lit("chapters").alias("rule"), "n")
    return found.unionByName(totals)


def first_passing(attempts: DataFrame, key: list[str], passed: Column, value: str, most: int = 3) -> DataFrame:
    """The value of the first of at most `most` attempts that passed, null if none did; and how many were made."""
    tried = attempts.where(F.col("attempt") <= most)
    return tried.groupBy(*key).agg(F.min_by(F.when(passed, F.col(value)), F.when(passed, F.col("attempt"))).alias(value), F.min(F.when(passed, F.col("attempt"))).alias("attempt"), F.count("*").alias("attempts"))


#: Seconds before the next attempt are a power of two of the attempt's number (from 0), this many at most.
LONGEST_WAIT = 30


def backoff(attempt: Column, unit: int = 1) -> Column:
    """Seconds to wait after an attempt that is to be made again; the first attempt is 1."""
    return (F.least(F.pow(F.lit(2), attempt - 1), F.lit(float(LONGEST_WAIT))) * unit).cast("long")


def attempt_sessions(log: DataFrame, key: list[str], ts: str = "ts", attempt: str = "attempt", code: str = "code", body: str = "body", unit: int = 1, slack: int = 1) -> DataFrame:
    """(key, start, attempts, waited, outcome): the attempts at one call, told apart by time.

    An attempt that is to be made again holds its session open for its backoff, by its number, and `slack` units of the
    answer; any other one ends it, but for what comes within a second. So the gap of a session follows each row.
    waited sums the backoffs, and outcome is that of the last attempt: ok, stop (the account ran out) or failed.
    """
    outcome = X.api_outcome(F.col(code), F.col(body))
    rows = log.select(*key, F.col(ts).alias("_ts"), F.col(attempt).alias("_n"), outcome.alias("_o")).withColumn("_wait", F.when(F.col("_o") == "retry", backoff(F.col("_n"), unit)).otherwise(0))
    gap = F.concat(F.when(F.col("_o") == "retry", F.col("_wait") + slack * unit).otherwise(1).cast("string"), F.lit(" seconds"))
    out = rows.groupBy(*key, F.session_window("_ts", gap).alias("_s")).agg(F.count("*").alias("attempts"), F.sum("_wait").alias("waited"), F.max_by("_o", F.struct("_ts", "_n")).alias("_o"))
    return out.select(*key, F.col("_s.start").alias("start"), "attempts", "waited", F.when(F.col("_o") == "retry", "failed").otherwise(F.col("_o")).alias("outcome"))


def dictionary_quality(words: DataFrame, wanted: DataFrame, word: str = "word", meaning: str = "meaning") -> DataFrame:
    """One row: entries, empty meanings, share of short ones, and the share of wanted words (copies count) found."""
    m = X.strip(F.coalesce(F.col(meaning), F.lit("")))
    sums = words.agg(F.count("*").alias("entries"), F.count_if(m == "").alias("empty"), F.count_if(F.length(m).between(1, 2)).alias("short"))
    cover = wanted.join(words.select(F.col(word).alias("_w")).distinct(), F.col(word) == F.col("_w"), "left").agg(F.count("*").alias("wanted"), F.count("_w").alias("found"))
    return sums.crossJoin(cover)


#: Parts of a meaning that show a raw format, and how many lengths of words are listed.
RAW_FORMATS, LENGTHS = ["[", "]", "/zhōng/", "/xué/", "(Tw)", "(Hk)"], 10


def dictionary_lengths(words: DataFrame, word: str = "word", meaning: str = "meaning") -> DataFrame:
    """(length, entries, suspicious): entries by the length of their word, the LENGTHS shortest, and how many meanings of each look raw."""
    raw = F.lit(False)
    for part in RAW_FORMATS:
        raw = raw | F.coalesce(F.col(meaning), F.lit("")).contains(part)
    return words.groupBy(F.length(word).cast("long").alias("length")).agg(F.count("*").alias("entries"), F.count_if(raw).alias("suspicious")).orderBy("length").limit(LENGTHS)
