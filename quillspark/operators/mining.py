"""Mining of names: n-grams pruned by their parts, neighbour entropy, cohesion and suppression of parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import cut, small

#: Least entropy and cohesion of a name, longest gram, candidates kept.
ENTROPY, COHESION, LONGEST, RARE, COMMON = 1.0, 20.0, 6, 600, 200
#: Characters of the grams that are counted without a look at others, and of a piece of a long run.
SHORT, STRETCH = 3, 1024


def runs(docs: DataFrame, script: str = X.CJK, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, run_no, run): maximal runs of a script, in order."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"([{script}]+)"), F.lit(1))).alias("run_no", "run"))


def weighted(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run, first, last, w): the distinct runs with how often they occur, stored; grams start at places first to last.

    Runs over STRETCH characters are cut into pieces that share what a gram and its neighbours need, so that each
    place is counted once and no substring is taken far into a long text.
    """
    at = F.col("k") * STRETCH
    pieces = found.select("run", F.length("run").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / STRETCH).cast("int"))).alias("k"))
    first = F.when(F.col("k") == 0, 1).otherwise(2)
    places = F.least(F.lit(STRETCH), F.col("n") - at)
    pieces = pieces.select(F.when(F.col("n") <= STRETCH, F.col("run")).otherwise(F.substring("run", at + 2 - first, first - 1 + places + longest)).alias("run"), first.alias("first"), (first + places - 1).alias("last"))
    return cut(pieces.groupBy("run", "first", "last").agg(F.count("*").alias("w")))


def _weighted(found: DataFrame, longest: int) -> DataFrame:
    return found if "w" in found.columns else weighted(found, longest)


def occurrences(found: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, run, i, n, w) for each place of a gram of the given sizes in weighted runs."""
    rows = found.select("run", "first", "last", "w", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    rows = rows.withColumn("last", F.least("last", F.length("run") - F.col("n") + 1)).where("last >= first")
    return rows.select("run", "w", "n", F.explode(F.sequence("first", "last")).alias("i")).withColumn("gram", F.substring("run", F.col("i"), F.col("n")))


def frequent_grams(found: DataFrame, longest: int = LONGEST, least: int | None = None) -> tuple[DataFrame, int, int]:
    """Counts (gram, n) of all grams up to `longest` with at least `least` places, with the total and the threshold.

    found are runs (run), or weighted() runs, of which each distinct one is read once for the grams up to SHORT
    characters and once for the longer ones. A longer gram is only counted if the short grams at its ends are
    frequent, as they must be if it is; they are broadcast if they measure small, as at the default threshold, which
    leaves 200,000 at most of each size. Counts are partial sums, so frequent grams do not gather in one task.
    """
    found = _weighted(found, longest)
    total = found.agg(F.coalesce(F.sum((F.col("last") - F.col("first") + 1) * F.col("w")), F.lit(0))).first()[0] or 1
    least = max(5, total // 200_000) if least is None else least
    counted = lambda places: places.groupBy("gram").agg(F.sum("w").alias("n")).where(F.col("n") >= least)
    short = cut(counted(occurrences(found, list(range(1, min(SHORT, longest) + 1)))))
    if longest <= SHORT:
        return short, total, least
    ends = short.where(F.length("gram") == SHORT)
    places = occurrences(found, list(range(SHORT + 1, longest + 1)))
    places = places.join(small(ends.select(F.col("gram").alias("head")), 64), F.left("gram", F.lit(SHORT)) == F.col("head"), "left_semi")
    places = places.join(small(ends.select(F.col("gram").alias("tail")), 64), F.right("gram", F.lit(SHORT)) == F.col("tail"), "left_semi")
    return short.unionByName(cut(counted(places))), total, least


def entropy(found: DataFrame, grams: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, left_entropy, right_entropy) in nats; every edge of a run counts as a neighbour of its own."""
    places = occurrences(_weighted(found, longest), list(range(2, longest + 1))).join(small(grams.select("gram"), 64), "gram", "left_semi")
    lft = F.when(F.col("i") == 1, "^").otherwise(F.substring("run", F.col("i") - 1, F.lit(1)))
    rgt = F.when(F.col("i") + F.col("n") > F.length("run"), "$").otherwise(F.substring("run", F.col("i") + F.col("n"), F.lit(1)))
    sides = places.select("gram", "w", F.explode(F.array(F.struct(F.lit("l").alias("side"), lft.alias("ch")), F.struct(F.lit("r").alias("side"), rgt.alias("ch")))).alias("x"))
    counts = sides.groupBy("gram", "x.side", "x.ch").agg(F.sum("w").alias("n"))
    edge = F.col("ch").isin("^", "$")
    sums = counts.groupBy("gram", "side").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(edge, F.col("n"))), F.lit(0)).alias("edge"), F.coalesce(F.sum(F.when(~edge, F.col("n") * F.log("n"))), F.lit(0.0)).alias("nlogn"), F.coalesce(F.sum(F.when(~edge, F.col("n"))), F.lit(0)).alias("inner"))
    value = (F.col("inner") * F.log("total") - F.col("nlogn")) / F.col("total") + F.col("edge") / F.col("total") * F.log("total")
    return sums.groupBy("gram").agg(F.max(F.when(F.col("side") == "l", value)).alias("left_entropy"), F.max(F.when(F.col("side") == "r", value)).alias("right_entropy"))


def cohesion(counts: DataFrame, total: int) -> DataFrame:
    """(gram, cohesion): the least ratio of a gram's count to what its two parts would give by chance."""
    cuts = counts.where(F.length("gram") > 1).select("gram", F.col("n").alias("n"), F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("i"))
    cuts = cuts.select("gram", "n", F.expr("substring(gram, 1, i)").alias("a"), F.expr("substring(gram, i + 1)").alias("b"))
    head, tail = counts.select(F.col("gram").alias("a"), F.col("n").alias("na")), counts.select(F.col("gram").alias("b"), F.col("n").alias("nb"))
    return cuts.join(head, "a").join(tail, "b").groupBy("gram").agg(F.min(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb"))).alias("cohesion"))


def suppressed(kept: DataFrame, common: DataFrame, surnames: list[str]) -> DataFrame:
    """(gram) to drop: parts that live in a longer gram, and longer grams that are a name with an ordinary word."""
    cuts = kept.select(F.col("gram").alias("h"), F.col("n").alias("hn"), F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("i"))
    cuts = cuts.select("h", "hn", "i", F.explode(F.expr("sequence(2, length(h) - i + 1)")).alias("size")).where("size < length(h)")
    parts = cuts.withColumn("g", F.expr("substring(h, i, size)")).select("h", "hn", "g").distinct().join(kept.select(F.col("gram").alias("g"), F.col("n").alias("gn")), "g")
    at = F.instr(F.col("h"), F.col("g"))
    rest = F.concat(F.expr("substring(h, 1, instr(h, g) - 1)"), F.substring(F.col("h"), at + F.length("g"), F.length("h")))
    parts = parts.withColumn("rest", rest).join(common.select(F.col("word").alias("rest")).distinct().withColumn("usual", F.lit(True)), "rest", "left")
    short = F.col("hn") >= 0.8 * F.col("gn")
    full_name = (F.length("rest") == 1) & F.col("h").startswith(F.col("rest")) & F.col("rest").isin(*surnames) if surnames else F.lit(False)
    long = ~short & ~full_name & (((F.length("rest") == 1) & (F.col("gn") >= 2 * F.col("hn"))) | (F.coalesce("usual", F.lit(False)) & (F.col("gn") >= 5 * F.col("hn"))))
    return parts.where(short).select(F.col("g").alias("gram")).unionByName(parts.where(long).select(F.col("h").alias("gram"))).distinct()


def name_candidates(docs: DataFrame, common: DataFrame, idioms: DataFrame, surnames: list[str] = (), stop_start: str = "", stop_end: str = "", script: str = X.CJK, doc: str = "doc_id", text: str = "text", least: int | None = None, rare: int = RARE, usual: int = COMMON) -> DataFrame:
    """(zh, count, example, common, rank): names by statistics alone, ranked by count, surnames weighing double.

    common(word) are dictionary words, idioms(key) never names. The example is the first place, two places for common
    words. Ties in rank are settled by the text of the gram.
    """
    found = weighted(runs(docs, script, doc, text))
    counts, total, _ = frequent_grams(found, least=least)
    grams = counts.where(F.length("gram") > 1).join(idioms.select(F.col("key").alias("gram")), "gram", "left_anti")
    first, last = F.substring("gram", 1, 1), F.expr("substring(gram, length(gram), 1)")
    grams = grams.where(~first.isin(*(stop_start or "\x00")) & ~last.isin(*(stop_end or "\x00")))
    kept = grams.join(entropy(found, grams), "gram").join(cohesion(counts, total), "gram").where((F.least("left_entropy", "right_entropy") >= ENTROPY) & (F.col("cohesion") >= COHESION)).select("gram", "n")
    kept = cut(kept)
    names = kept.join(suppressed(kept, common, list(surnames)), "gram", "left_anti").join(common.select(F.col("word").alias("gram")).distinct().withColumn("common", F.lit(True)), "gram", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    bonus = F.when(first.isin(*surnames) & (F.length("gram") <= 3), 2).otherwise(1) if surnames else F.lit(1)
    # Of each kind only the first by weight are wanted: limits of tasks meet, the kinds are never ranked whole.
    tops = [names.where(kind).withColumn("weight", F.col("n") * bonus).orderBy(F.desc("weight"), "gram").limit(most) for kind, most in ((~F.col("common"), rare), (F.col("common"), usual))]
    place = F.row_number().over(Window.partitionBy("common").orderBy(F.desc("weight"), "gram"))
    ranked = cut(tops[0].unionByName(tops[1]).withColumn("rank", place).drop("weight"))
    from quillspark.operators.terms import containment

    hits = containment(docs, ranked.select(F.col("gram").alias("term")), doc, text)
    places = Window.partitionBy("term").orderBy(doc)
    hits = cut(hits.withColumn("k", F.row_number().over(places)).where("k <= 2"))
    hits = docs.select(doc, text).join(small(hits, 256), doc)
    hits = hits.withColumn("snip", X.snippet(F.col(text), F.col("first_pos"), F.length("term"), 18)).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("k", "snip"))).alias("s"))
    out = ranked.join(hits, F.col("gram") == F.col("term"), "left")
    examples = F.transform(F.slice("s", 1, F.when(F.col("common"), 2).otherwise(1)), lambda x: x["snip"])
    return out.select(F.col("gram").alias("zh"), F.col("n").alias("count"), F.array_join(examples, " / ").alias("example"), "common", "rank")
