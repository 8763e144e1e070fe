"""Terms and idioms: containment joins, admission filters, merges, votes and checks of use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import cut, numbered
from quillspark.operators import dictionary

#: Bytes of terms that one trie may hold.
TRIE = 16 << 20

#: Terms for a chapter, idiom hints for a chapter.
MAX_TERMS, MAX_IDIOMS = 300, 60
LITERAL = "nghĩa đen"
#: Terms of a rendering that are listed in a row.
LISTED = 1000
#: The mark of an idiom in a meaning, and the heads of meanings that say nothing by themselves.
MARKER, REFUSED = "(thành ngữ)", [LITERAL, "xem ", "biến thể"]


def containment(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", term: str = "term", stretch: int = 8, most: int = TRIE) -> DataFrame:
    """(doc, term, first_pos): every term that a text contains, with its first 1-based place.

    The dictionary is measured first. Up to `most` bytes of terms are broadcast, and each text is read once against the
    trie of all of them, without a shuffle. Larger dictionaries are looked up by each term's first `stretch`
    characters (a shorter term's own), joined to the texts' distinct runs of those sizes; only what meets is
    searched. Both give the same rows. Empty and null terms are in no text.
    """
    keyed = cut(terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct())
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.length("text") > 0)
    if (keyed.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= most:
        return dictionary.first_places(source, [r["term"] for r in keyed.collect()]).withColumnRenamed("doc", doc)
    sizes = sorted(r["n"] for r in keyed.select(F.least(F.length("term"), F.lit(stretch)).alias("n")).distinct().collect())
    keyed = keyed.withColumn("key", F.substring("term", 1, stretch))
    met = _beginnings(source, sizes).join(keyed, "key").select("doc", "term").distinct().join(source, "doc")
    met = met.where(F.col("text").contains(F.col("term")))
    return met.select(F.col("doc").alias(doc), "term", F.instr(F.col("text"), F.col("term")).alias("first_pos"))


def _beginnings(source: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, key): the distinct runs of the given sizes in rows (doc, text)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column("text").to_pylist()):
                keys = {value[at : at + n] for n in sizes for at in range(len(value) - n + 1)}
                owner = batch.column("doc").take(pa.array([i] * len(keys), pa.int32()))
                yield pa.RecordBatch.from_arrays([owner, pa.array(list(keys), pa.string())], ["doc", "key"])

    return source.mapInArrow(runs, f"doc {source.schema['doc'].dataType.simpleString()}, key string")


def terms_of_chapter(found: DataFrame, doc: str = "doc_id", most: int = MAX_TERMS) -> DataFrame:
    """At most `most` terms of each text, the longest first (then by ord), returned in the order of ord."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(F.length("term")), "ord"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def split_known(terms: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """known: whether the key is in another table (common words, idioms): the forced and the ambiguous terms."""
    marks = known.select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    return terms.join(marks, F.col(key) == F.col("_key"), "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_key", "_known")


def admitted_term(zh: Column, vi: Column, text: Column, script: str = X.CJK) -> Column:
    """Whether a proposed term goes into the glossary."""
    z, v = X.strip(zh), X.strip(vi)
    return F.coalesce((F.length(z).between(1, 12)) & F.length(v).between(1, 60) & X.has_script(z, script) & ~X.has_script(v, script) & text.contains(z) & (X.capital_words(v) >= 2), F.lit(False))


def admitted_idiom(zh: Column, vi: Column, text: Column, output: Column, script: str = X.CJK) -> Column:
    """Whether a reported idiom and its rendering are kept: both must occur, and the rendering must not be a gloss."""
    z, v = X.strip(zh), F.regexp_replace(X.strip(vi), "^[\"“”']+|[\"“”']+$", "")
    return F.coalesce(F.length(z).between(3, 24) & F.length(v).between(1, 80) & X.has_script(z, script) & ~X.has_script(v, script) & ~F.lower(v).startswith(LITERAL) & text.contains(z) & F.lower(output).contains(F.lower(v)), F.lit(False))


def admitted_name(vi: Column, script: str = X.CJK) -> Column:
    v = X.strip(vi)
    return F.coalesce(F.length(v).between(1, 60) & ~X.has_script(v, script) & (X.capital_words(v) >= 2), F.lit(False))


def admitted_rendering(vi: Column, script: str = X.CJK) -> Column:
    v = X.strip(vi)
    return F.coalesce(F.length(v).between(1, 60) & ~X.has_script(v, script) & ~F.lower(v).startswith(LITERAL), F.lit(False))


def clean_meaning(meaning: Column) -> Column:
    """A dictionary meaning fit for a hint, without the idiom's marker; empty for glosses, references, script and brackets."""
    m = F.trim(F.replace(F.coalesce(meaning, F.lit("")), F.lit(MARKER), F.lit("")), F.lit(" ;,"))
    low = F.lower(m)
    refused = X.has_script(m) | m.contains("[")
    for head in REFUSED:
        refused = refused | low.startswith(head)
    return F.when(refused, "").otherwise(m)


def is_common(meaning: Column) -> Column:
    """Whether the first letter of a meaning is in lower case: an ordinary word."""
    return F.regexp_extract(meaning, r"\p{L}", 0).rlike(r"\p{Ll}")


def merge_new(glossary: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of fresh(novel_id, ord, zh, vi, key) whose key is in no glossary row and first among themselves."""
    new = fresh.join(glossary.select("novel_id", "key"), ["novel_id", "key"], "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy("novel_id", "key").orderBy("ord"))).where("_n = 1").drop("_n")


def duplicate_renderings(glossary: DataFrame, zh: str = "zh", vi: str = "vi", order: str = "ord", size: int | None = LISTED) -> DataFrame:
    """(vi, part, names, n): renderings that several terms share, their terms in order, `size` of them in a row.

    With no size all terms of a rendering are in one row, of part 0, however many they are.
    """
    rows = glossary.select(F.col(vi).alias("vi"), F.col(order).alias("o"), F.col(zh).cast("string").alias("z"))
    if size is None:
        listed = rows.where("vi IS NOT NULL").groupBy("vi").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("o", "z"))).alias("all")).where("n > 1")
        return listed.select("vi", F.lit(0).cast("long").alias("part"), F.array_join(F.transform("all", lambda x: x["z"]), " / ").alias("names"), "n")
    counts = rows.groupBy("vi").agg(F.count("*").alias("n")).where("n > 1 AND vi IS NOT NULL")
    shared = numbered(rows.join(counts, "vi"), ["vi"], ["o", "z"]).withColumn("part", F.floor((F.col("number") - 1) / size))
    listed = shared.groupBy("vi", "part", "n").agg(F.sort_array(F.collect_list(F.struct("number", "z"))).alias("all"))
    return listed.select("vi", "part", F.array_join(F.transform("all", lambda x: x["z"]), " / ").alias("names"), "n")


def lower_renderings(glossary: DataFrame, vi: str = "vi") -> DataFrame:
    """Terms whose rendering has no capital: an ordinary word, it seems, that is forced to be a name."""
    return glossary.where(F.col(vi) == F.lower(F.col(vi)))


def examples(found: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text", margin: int = 18) -> DataFrame:
    """(term, chapters, first_doc, example): in how many texts each term occurs, and its first place in the first of them."""
    counts = found.groupBy("term").agg(F.count_distinct(doc).alias("chapters"), F.min(F.struct(F.col(doc).alias("doc"), "first_pos")).alias("m"))
    met = counts.join(docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")), F.col("m.doc") == F.col("_doc"))
    shown = X.snippet(F.col("_text"), F.col("m.first_pos").cast("int"), F.length("term"), margin)
    return met.select("term", "chapters", F.col("m.doc").alias("first_doc"), shown.alias("example"))


def uses(events: DataFrame, key: str, place: str) -> DataFrame:
    """(key, last_seen, count) from one row for each use."""
    return events.groupBy(key).agg(F.max(place).alias("last_seen"), F.count("*").alias("count"))


def purge(meta: DataFrame, now: Column | int, idle: int = 100) -> DataFrame:
    """purged: used once and idle for over `idle` chapters. Only metadata goes, never the term."""
    return meta.withColumn("purged", (F.col("count") == 1) & (F.lit(now) - F.col("last_seen") > idle))


def vote(events: DataFrame, key: str, variant: str, order: list[str]) -> DataFrame:
    """(key, rendering, chapters, first, last): the rendering after all events of a key, in order.

    A variant replaces the current one only with strictly more votes, so ties keep what came first: in the end the
    rendering is the variant that was first to reach the most votes of any. Votes are counted by window over the events
    of each variant; no key's events are gathered.
    """
    at = F.struct(*order).alias("at")
    votes = events.select(key, F.col(variant).cast("string").alias("v"), at, F.col(order[0]).alias("place"))
    votes = votes.withColumn("vote", F.row_number().over(Window.partitionBy(key, "v").orderBy("at")))
    reached = votes.groupBy(key, "vote").agg(F.min_by("v", F.struct("at", "v")).alias("v"), F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    best = F.max_by("v", "vote").alias("rendering")
    return reached.groupBy(key).agg(best, F.sum("n").alias("chapters"), F.min("first").alias("first"), F.max("last").alias("last"))


def document_frequency(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(term, chapters): in how many texts a term occurs."""
    return found.groupBy("term").agg(F.count_distinct(doc).alias("chapters"))


def commonest(found: DataFrame, least: int = 3, most: int = 300, doc: str = "doc_id") -> DataFrame:
    """(term, chapters, first_doc): the `most` terms that occur in the most texts, in `least` at least; ties by term hash."""
    counts = found.groupBy("term").agg(F.count_distinct(doc).alias("chapters"), F.min(doc).alias("first_doc")).where(F.col("chapters") >= least)
    return counts.orderBy(F.desc("chapters"), F.md5(F.col("term").cast("binary"))).limit(most)


def first_hits(found: DataFrame, doc: str = "doc_id", most: int = MAX_IDIOMS) -> DataFrame:
    """At most `most` terms of each text by first place, then term; hit is their rank."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("first_pos", "term"))
    return found.withColumn("hit", rank).where(F.col("hit") <= most)


def known_rendering(approved: Column, memory_vi: Column, variants: Column, curated_vi: Column) -> Column:
    """Approved memory, then the curated list, then memory that has been used; empty if none."""
    return F.coalesce(F.when(approved, F.nullif(memory_vi, F.lit(""))), F.nullif(curated_vi, F.lit("")), F.when(F.coalesce(F.size(variants), F.lit(0)) > 0, F.nullif(memory_vi, F.lit(""))), F.lit(""))


def fresh_hint(source: Column, memory_vi: Column, detector_vi: Column) -> Column:
    vi = F.coalesce(memory_vi, F.lit(""))
    meaning = F.when(vi != "", vi).otherwise(F.coalesce(detector_vi, F.lit("")))
    return F.when((source == "chuan_bi") & (vi != ""), F.concat(F.lit("gợi ý: "), vi)).when(meaning != "", F.concat(F.lit("nghĩa: "), meaning)).otherwise("")


def missing_terms(source: Column, target: Column, terms: Column) -> Column:
    """The terms (array of struct zh, vi; longest first) that the target renders less often than the source has them.

    Each found term is masked in both texts before the next, so that a short term inside a long one is not counted.
    """
    start = F.struct(source.alias("s"), F.lower(target).alias("d"), F.array().cast("array<string>").alias("bad"))

    def step(state: Column, term: Column) -> Column:
        zh, vi = term["zh"], F.lower(term["vi"])
        n, m = X.occurrences(state["s"], zh), X.occurrences(state["d"], vi)
        hit = F.struct(
            F.replace(state["s"], zh, F.lit("\x00")).alias("s"), F.when(F.length(vi) > 0, F.replace(state["d"], vi, F.lit("\x00"))).otherwise(state["d"]).alias("d"),
            F.when(m < n, F.concat(state["bad"], F.array(zh))).otherwise(state["bad"]).alias("bad"),
        )
        return F.when(n > 0, hit).otherwise(state)

    return F.aggregate(terms, start, step, lambda s: s["bad"])


def missing_by_paragraph(title: Column, source: Column, target: Column, terms: Column) -> Column:
    """The terms (array of struct zh, vi; longest first) that a chapter's translation misses, in their order.

    Paragraph by paragraph where both have as many, so that one paragraph's surplus does not hide another's lack; else
    the whole chapter, its title included.
    """
    each = F.flatten(F.zip_with(source, target, lambda s, t: missing_terms(s, t, terms)))
    whole = missing_terms(X.chapter_text(title, source), F.array_join(target, "\n"), terms)
    flagged = F.when((F.size(source) == F.size(target)) & (F.size(source) > 0), each).otherwise(whole)
    return X.let(flagged, lambda bad: F.transform(F.filter(terms, lambda t: F.array_contains(bad, t["zh"])), lambda t: t["zh"]))


def apply_review(decisions: DataFrame, curated: DataFrame) -> DataFrame:
    """(key, vi, status, route, outcome): review decisions routed to the curated list or the memory.

    Rows of decisions: key, vi, status, src. src "tuyen" of a curated key updates or deletes it; all others approve
    or reject a memory entry. Decisions with another status, or an empty key, are left out.
    """
    rows = decisions.where(F.col("status").isin("approved", "rejected") & (F.col("key") != ""))
    listed = curated.select(F.col("key").alias("_key"), F.col("vi").alias("_vi"))
    rows = rows.join(listed, F.col("key") == F.col("_key"), "left")
    route = F.when((F.col("src") == "tuyen") & F.col("_key").isNotNull(), "tuyen").otherwise("dich")
    vi = X.strip(F.coalesce("vi", F.lit("")))
    outcome = (
        F.when((route == "tuyen") & (F.col("status") == "rejected"), "delete").when((route == "tuyen") & (vi != "") & (vi != F.col("_vi")), "update").when(route == "tuyen", "same")
        .when((F.col("status") == "approved") & (vi != "") & ~X.has_script(vi), "approve").otherwise("reject")
    )
    return rows.select("key", vi.alias("vi"), "status", route.alias("route"), outcome.alias("outcome"))


def greedy_spans(text: Column, terms: list[str]) -> Column:
    """Matches of a small dictionary, leftmost and longest first, without overlaps (an array of terms)."""
    if not terms:
        return F.array().cast("array<string>")
    from re import escape

    return F.regexp_extract_all(text, F.lit("|".join(escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))), F.lit(0))


def mark_spans(text: Column, terms: dict[str, str]) -> Column:
    """Terms replaced by their renderings between zero-width spaces; restore_spans() takes the marks out again.

    A small dictionary as one pattern: the text is cut at its matches, leftmost and longest first, in one pass. For
    large ones see marked_texts().
    """
    if not terms:
        return text
    from re import escape

    pattern = F.lit("|".join(escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))))
    rendering = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    marked = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda t: F.concat(F.lit("\u200b"), rendering[t], F.lit("\u200b")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), marked, lambda between, mark: F.concat(between, F.coalesce(mark, F.lit("")))), "")


def term_spans(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", term: str = "term", most: int = TRIE) -> DataFrame:
    """(doc, start, term): matches of a dictionary of any size up to `most` bytes, leftmost and longest first, without overlaps."""
    words = _dictionary(terms.select(F.col(term).alias("zh"), F.col(term).alias("vi")), most)
    return dictionary.spans(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), sorted(words)).withColumnRenamed("doc", doc)


def marked_texts(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", most: int = TRIE) -> DataFrame:
    """(doc, text): texts with the terms (zh) replaced by their renderings (vi) as in mark_spans(), by a whole dictionary.

    Of several renderings of a term the least counts; null renderings are empty, empty terms are in no text.
    """
    return dictionary.marked(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), _dictionary(terms, most)).select(F.col("doc").alias(doc), F.col("text").alias(text))


def _dictionary(terms: DataFrame, most: int) -> dict[str, str]:
    """Terms and renderings of a dictionary that measures at most `most` bytes; a larger one is refused."""
    rows = cut(terms.where(F.length("zh") > 0).groupBy("zh").agg(F.coalesce(F.min("vi"), F.lit("")).alias("vi")))
    size = rows.agg(F.sum(F.octet_length("zh") + F.octet_length("vi"))).first()[0] or 0
    if size > most:
        raise ValueError(f"a dictionary of {size} bytes is over {most}: choose the terms that occur with containment() first")
    return {r["zh"]: r["vi"] for r in rows.collect()}


def restore_spans(text: Column) -> Column:
    return F.replace(text, F.lit("\u200b"), F.lit(""))
