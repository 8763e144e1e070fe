"""Whole jobs over many novels at once, from crawled chapters and earlier translations to books and their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import cut, small
from quillspark.operators import novel_run as N
from quillspark.operators import validation
from quillspark.operators.heal import heal, take_stashed


def run_novels(raw: DataFrame, translated: DataFrame, replies: DataFrame, cache: DataFrame, stash: DataFrame, glossary: DataFrame, common: DataFrame, profiles: DataFrame, script: str = X.CJK) -> dict[str, DataFrame]:
    """raw, translated, cache, stash, new_terms, unused, warnings, pages, manifest and summary of a job over all novels.

    raw and translated (novel_id, pos, title, paragraphs) are healed first. Chapters behind the healed translation are
    translated: from the stash (novel_id, hash, title, paragraphs), the cache of their healed places (novel_id, pos,
    title, paragraphs, source_hash), or replies (hash, attempt, code, body), which are recorded by the content hash of
    what was asked, so that a chapter finds its replies wherever healing puts it. Terms of a novel's glossary (novel_id,
    ord, zh, vi) that a new chapter doesn't render are unused; words of common (word) are not asked for. Translations
    are validated against the healed chapters and become pages and manifests of the books of profiles (novel_id,
    book_id, title, author).

    raw, translated, cache and stash are what the next job takes. summary has a row for each novel of profiles; one without chapters is an error,
    and one whose account ran out stops without holding up others. Novels without a profile are translated, but have
    neither manifest nor summary. Repeated rows of replies count as one.
    """
    healed = heal(raw, translated)
    done = cut(healed["translated"])
    before = done.groupBy("novel_id").agg(F.count("*").alias("before"))
    # Texts of all chapters are met with their healed places once; later steps read what was written then.
    places = healed["places"]
    most = places.groupBy("novel_id").agg((F.count("number") * 2 >= F.count("*")).alias("most"))
    places = places.join(most, "novel_id").select("novel_id", "pos", "new_pos", F.when(F.col("most"), F.col("number")).otherwise((F.col("new_pos") + 1).cast("long")).alias("label"), "hash")
    chapters = cut(raw.join(small(places, 128), ["novel_id", "pos"]).select("novel_id", F.col("new_pos").alias("pos"), "title", "paragraphs", "label", "hash"))
    before = small(cut(before), 64)
    todo = chapters.join(before, "novel_id", "left").where(F.col("pos") >= F.coalesce("before", F.lit(0))).drop("before")
    left = cut(healed["stash"].unionByName(stash.select("novel_id", "hash", "title", "paragraphs")))
    asked = todo.select("novel_id", "pos", "hash").join(replies.distinct(), "hash").drop("hash")
    run = N.translate(todo, asked, cache, left, glossary, script)
    written = cut(run["written"])
    fresh = todo.join(written.select("novel_id", "pos"), ["novel_id", "pos"], "left_semi")
    unused = cut(N.unused_terms(fresh, written, N.chapter_terms(fresh, glossary, common)))
    whole = done.unionByName(written.drop("origin"))
    warnings = cut(validation.report(chapters, whole, script))
    pages = N.book_pages(whole.withColumn("is_title_entry", F.lit(False)))
    manifest = cut(N.book_manifest(pages, profiles))
    count = lambda df, name: df.groupBy("novel_id").agg(F.count("*").alias(name))
    summary = profiles.select("novel_id").distinct().join(healed["summary"].select("novel_id", "total", "duplicates", "moved"), "novel_id", "left").join(before, "novel_id", "left")
    summary = summary.join(run["summary"], "novel_id", "left").join(count(unused, "unused"), "novel_id", "left").join(count(warnings, "warnings"), "novel_id", "left")
    summary = summary.join(manifest.groupBy("novel_id").agg(F.max("pages").alias("pages")), "novel_id", "left")
    status = F.when(F.col("total").isNull(), "error").otherwise(F.coalesce("status", F.lit("done")))
    numbers = ["total", "duplicates", "moved", "before", "written", "kept", "failed", "waiting", "unused", "warnings", "pages"]
    used = left.join(written.where("origin = 'stash'").join(todo, ["novel_id", "pos"]).select("hash").distinct(), "hash", "left_semi").select("hash")
    return {
        "raw": chapters.select("novel_id", "pos", "title", "paragraphs"), "translated": whole, "cache": run["kept"], "stash": take_stashed(left, used)[1], "new_terms": run["new_terms"],
        "unused": unused, "warnings": warnings, "pages": pages, "manifest": manifest,
        "summary": summary.select("novel_id", status.alias("status"), *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers]),
    }
