"""Runs over whole novels on recorded replies: preparation of names and idioms, translation of chapters, books and paths.

Replies of a model are tables; nothing here calls a service. All novels of a table run side by side, each on the state
it had when the run began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import cut, numbered, running, small
from quillspark.operators import chapters as C
from quillspark.operators import terms, validation
from quillspark.sources import responses

#: Candidates of a batch, fixed names shown with a batch, attempts at a chapter.
NAME_BATCH, SHOWN, ATTEMPTS = 150, 400, 3
#: The outcome of a novel's run in a summary.
OUTCOMES = {"done": "HOAN TAT", "stopped": "DA DUNG (resume khi chay lai)", "stopped_balance": "DUNG DO HET SO DU API", "error": "LOI"}


# Preparation
def unchecked_names(candidates: DataFrame, checked: DataFrame, glossary: DataFrame) -> DataFrame:
    """Candidates (novel_id, zh, rank) that were not looked at before and are in no glossary, with their batch.

    checked and glossary have (novel_id, zh). Batches are runs of NAME_BATCH by rank.
    """
    known = checked.select("novel_id", "zh").unionByName(glossary.select("novel_id", "zh"))
    return C.batches(candidates.join(known, ["novel_id", "zh"], "left_anti"), ["novel_id"], ["rank", "zh"], NAME_BATCH)


def decided_names(todo: DataFrame, replies: DataFrame, script: str = X.CJK) -> DataFrame:
    """(novel_id, batch, zh, vi): renderings that a reply gives for names of its own batch and that pass as names."""
    given = replies.select("novel_id", "batch", X.strip(F.col("zh")).alias("zh"), X.strip(F.col("vi")).alias("vi"))
    return given.join(todo.select("novel_id", "batch", "zh"), ["novel_id", "batch", "zh"], "left_semi").where(terms.admitted_name(F.col("vi"), script))


def shown_names(glossary: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first names (novel_id, ord, zh, vi) of each glossary, as many as a batch is shown."""
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy("ord"))
    return glossary.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def unchecked_idioms(counts: DataFrame, memory: DataFrame, curated: DataFrame, checked: DataFrame) -> DataFrame:
    """Idioms (novel_id, key, chapters) that still need a rendering.

    Left out are curated ones (key), those looked at before (novel_id, key), and those whose entry in memory
    (novel_id, key, approved, source, uses) is approved, in use, or was prepared.
    """
    settled = memory.where("approved OR uses > 0 OR source = 'chuan_bi'").select("novel_id", "key").unionByName(checked.select("novel_id", "key"))
    return counts.join(curated.select("key").distinct(), "key", "left_anti").join(settled, ["novel_id", "key"], "left_anti").select("novel_id", "key", "chapters")


def prepare(chapters: DataFrame, candidates: DataFrame, glossary: DataFrame, state: DataFrame, checked: DataFrame, replies: DataFrame, script: str = X.CJK) -> dict[str, DataFrame]:
    """added, checked, state and summary of the preparation of all novels.

    state(novel_id, chapters, done): novels that are done at their present number of chapters are skipped. New names
    never replace one of the glossary (novel_id, ord, zh, vi); all candidates looked at are checked from now on.
    """
    sizes = chapters.groupBy("novel_id").agg(F.count("*").alias("chapters"))
    done = state.where("done").select("novel_id", "chapters", F.lit(True).alias("skipped"))
    novels = cut(sizes.join(done, ["novel_id", "chapters"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False))))
    todo = unchecked_names(candidates.join(novels.where("NOT skipped").select("novel_id"), "novel_id", "left_semi"), checked, glossary)
    todo = cut(todo)
    fresh = decided_names(todo, replies, script).join(todo.select("novel_id", "zh", "rank"), ["novel_id", "zh"])
    added = cut(terms.merge_new(glossary.withColumn("key", F.col("zh")), fresh.select("novel_id", F.col("rank").alias("ord"), "zh", "vi", F.col("zh").alias("key"))).drop("key"))
    counts = todo.groupBy("novel_id").agg(F.count("*").alias("candidates")).join(added.groupBy("novel_id").agg(F.count("*").alias("names_added")), "novel_id", "left")
    return {
        "added": added, "checked": checked.select("novel_id", "zh").unionByName(todo.select("novel_id", "zh")).distinct(), "state": novels.select("novel_id", "chapters", F.lit(True).alias("done")),
        "summary": novels.join(counts, "novel_id", "left").fillna(0, ["candidates", "names_added"]),
    }


# What a chapter is translated with
def chapter_terms(chapters: DataFrame, glossary: DataFrame, common: DataFrame, most: int = terms.MAX_TERMS) -> DataFrame:
    """(novel_id, pos, kind, ord, zh, vi): the terms of each novel's own glossary that occur in a chapter.

    chapters(novel_id, pos, title, paragraphs), glossary(novel_id, ord, zh, vi); at most `most` of a chapter, longest
    first. kind is ambiguous for those that are common words too, else forced.
    """
    texts = chapters.select(F.struct("novel_id", "pos").alias("at"), X.chapter_text(F.col("title"), F.col("paragraphs")).alias("text"))
    found = terms.containment(texts, glossary.select(F.col("zh").alias("term")), "at", "text")
    own = found.select("at", F.col("at.novel_id").alias("novel_id"), "term").join(glossary.select("novel_id", F.col("zh").alias("term"), "ord", "vi"), ["novel_id", "term"])
    chosen = terms.split_known(terms.terms_of_chapter(own, "at", most), common.select(F.col("word").alias("term")), "term")
    return chosen.select("novel_id", "at.pos", F.when(F.col("known"), "ambiguous").otherwise("forced").alias("kind"), "ord", F.col("term").alias("zh"), "vi")


def chapter_idioms(chapters: DataFrame, glossary: DataFrame, memory: DataFrame, curated: DataFrame, detector: DataFrame, most: int = terms.MAX_IDIOMS) -> DataFrame:
    """(novel_id, pos, kind, ord, zh, vi): the idioms of each chapter by first place, at most `most`.

    Idioms are keys of the novel's memory (novel_id, key, vi, approved, source, uses), of the curated list (key, vi) and
    of the detector (key, hint); terms of the novel's glossary are none. kind is known for those with a rendering to be
    used again, and hint for the others, whose vi is a suggestion or empty.
    """
    texts = chapters.select(F.struct("novel_id", "pos").alias("at"), X.chapter_text(F.col("title"), F.col("paragraphs")).alias("text"))
    keys = memory.select(F.col("key").alias("term")).unionByName(curated.select(F.col("key").alias("term"))).unionByName(detector.select(F.col("key").alias("term")))
    found = terms.containment(texts, keys, "at", "text").select("at", F.col("at.novel_id").alias("novel_id"), "term", "first_pos")
    remembered = memory.select("novel_id", F.col("key").alias("term"), F.col("vi").alias("m_vi"), "approved", "source", "uses", F.lit(True).alias("own"))
    listed, hints = curated.select(F.col("key").alias("term"), F.col("vi").alias("c_vi"), F.lit(True).alias("listed")), detector.select(F.col("key").alias("term"), F.col("hint"), F.lit(True).alias("detected"))
    rows = found.join(remembered, ["novel_id", "term"], "left").join(listed, "term", "left").join(hints, "term", "left").where("own OR listed OR detected")
    rows = rows.join(glossary.select("novel_id", F.col("zh").alias("term")), ["novel_id", "term"], "left_anti")
    rows = terms.first_hits(rows, "at", most)
    used = F.when(F.coalesce("uses", F.lit(0)) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    known = terms.known_rendering(F.coalesce("approved", F.lit(False)), F.col("m_vi"), used, F.col("c_vi"))
    fresh = terms.fresh_hint(F.coalesce("source", F.lit("")), F.col("m_vi"), F.col("hint"))
    return rows.select("novel_id", "at.pos", F.when(known != "", "known").otherwise("hint").alias("kind"), F.col("hit").cast("long").alias("ord"), F.col("term").alias("zh"), F.when(known != "", known).otherwise(fresh).alias("vi"))


def unused_terms(chapters: DataFrame, written: DataFrame, found: DataFrame) -> DataFrame:
    """(novel_id, pos, zh): forced terms of chapter_terms() that a written chapter does not render as often as they occur."""
    listed = found.where("kind = 'forced'").groupBy("novel_id", "pos").agg(F.array_sort(F.collect_list(F.struct((-F.length("zh")).alias("size"), "zh", "vi"))).alias("t"))
    met = chapters.select("novel_id", "pos", "title", "paragraphs").join(written.select("novel_id", "pos", F.col("paragraphs").alias("done")), ["novel_id", "pos"]).join(listed, ["novel_id", "pos"])
    pairs = F.transform("t", lambda x: F.struct(x["zh"].alias("zh"), F.coalesce(x["vi"], F.lit("")).alias("vi")))
    return met.select("novel_id", "pos", F.explode(terms.missing_by_paragraph(F.col("title"), F.col("paragraphs"), F.col("done"), pairs)).alias("zh"))


# Translation
def terms_block(found: DataFrame, headings: dict[str, str]) -> DataFrame:
    """(novel_id, pos, block): the terms of each chapter as text, kinds in the order of headings, lines in order.

    found(novel_id, pos, kind, ord, zh, vi); a line is "zh = vi", or zh alone without a rendering. Kinds without terms
    have no heading.
    """
    line = F.when(F.coalesce("vi", F.lit("")) != "", F.concat("zh", F.lit(" = "), "vi")).otherwise(F.col("zh"))
    lists = found.where(F.col("kind").isin(*headings)).groupBy("novel_id", "pos").pivot("kind", list(headings)).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))))
    parts = [F.when(F.size(k) > 0, F.concat(F.lit(h + "\n"), F.array_join(F.transform(k, lambda x: x["line"]), "\n"), F.lit("\n"))) for k, h in headings.items()]
    return lists.select("novel_id", "pos", F.concat_ws("\n", *parts).alias("block"))


def attempted(chapters: DataFrame, replies: DataFrame, script: str = X.CJK) -> DataFrame:
    """(novel_id, pos, reply, attempt, attempts, verdict): the first of up to ATTEMPTS replies that passes, repaired.

    replies(novel_id, pos, attempt, code, body). verdict is ok, stop where the account ran out, else why the last
    attempt was refused: retry (no answer), reply (no paragraphs found), paragraphs or script.
    """
    asked = chapters.select("novel_id", "pos", F.size("paragraphs").alias("size"))
    rows = replies.where(F.col("attempt") <= ATTEMPTS).join(asked, ["novel_id", "pos"])
    rows = rows.withColumn("outcome", X.api_outcome(F.col("code"), F.col("body"))).withColumn("r", F.when(F.col("outcome") == "ok", responses.reply(F.col("body"))))
    full = F.filter("r.paragraphs", lambda p: p.isNotNull() & X.filled(p))
    rows = rows.withColumn("done", F.transform(full, lambda p: F.replace(X.repair(p), F.lit("​"), F.lit(""))))
    verdict = F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("r").isNull(), "reply").otherwise(validation.sized_gate(F.col("size"), F.col("done"), script))
    rows = rows.withColumn("verdict", verdict).withColumn("made", F.struct(F.col("r.title").alias("title"), F.col("done").alias("paragraphs"), F.col("r.new_terms").alias("new_terms"), F.col("r.idioms").alias("idioms")))
    passed = F.col("verdict") == "ok"
    return rows.groupBy("novel_id", "pos").agg(
        F.min_by(F.when(passed, F.col("made")), F.when(passed, F.col("attempt"))).alias("reply"), F.min(F.when(passed, F.col("attempt"))).alias("attempt"), F.count("*").alias("attempts"),
        F.when(F.max(passed), "ok").when(F.max(F.col("verdict") == "stop"), "stop").otherwise(F.max_by("verdict", "attempt")).alias("verdict"),
    )


def translate(chapters: DataFrame, replies: DataFrame, cache: DataFrame, stash: DataFrame, glossary: DataFrame, script: str = X.CJK) -> dict[str, DataFrame]:
    """written, kept, failed, new_terms and summary of one run over all novels.

    chapters(novel_id, pos, title, paragraphs), with columns label and hash if they are not to be made here; a chapter's
    result is its stashed one (hash, title, paragraphs), else
    one of the cache that still fits (novel_id, pos, title, paragraphs, source_hash), else the first reply that passes.
    Chapters are written in order up to the first without a result (failed); later results are kept for the next run.
    Only written chapters give new terms to the glossary (novel_id, ord, zh, vi), and none replaces one of it.
    """
    rows = chapters if "label" in chapters.columns else C.labels(chapters)
    rows = rows if "hash" in rows.columns else rows.withColumn("hash", X.content_hash(F.col("title"), F.col("paragraphs")))
    # Results meet the chapters' sizes and titles; their texts are read again only for those that propose terms.
    rows = rows.select("novel_id", "pos", "title", F.size("paragraphs").alias("size"), "label", "hash")
    stashed = stash.groupBy("hash").agg(F.first(F.struct("title", "paragraphs")).alias("s"))
    saved = cache.select("novel_id", "pos", F.struct("title", "paragraphs").alias("c"), "source_hash")
    rows = rows.join(stashed, "hash", "left").join(saved, ["novel_id", "pos"], "left").join(attempted(chapters, replies, script), ["novel_id", "pos"], "left")
    own = F.col("source_hash").isNull() | (F.col("source_hash") == F.col("hash"))
    fits = F.coalesce(own & (F.size("c.paragraphs") == F.col("size")) & ~X.has_script(F.array_join("c.paragraphs", "\n"), script), F.lit(False))
    origin = F.when(F.col("s").isNotNull(), "stash").when(fits, "cache").when(F.col("reply").isNotNull(), "reply")
    rows = rows.withColumn("origin", origin)
    pick = lambda field: F.when(F.col("origin") == "stash", F.col(f"s.{field}")).when(F.col("origin") == "cache", F.col(f"c.{field}")).otherwise(F.col(f"reply.{field}"))
    title = F.coalesce(F.nullif(X.chapter_title(pick("title"), F.col("label")), F.lit("")), F.col("title"))
    rows = cut(rows.select("novel_id", "pos", "title", "hash", "origin", title.alias("done_title"), pick("paragraphs").alias("done"), "reply.new_terms", "reply.idioms", F.coalesce("verdict", F.lit("retry")).alias("verdict")))
    # The first chapter without a result ends what is written; that is settled on keys alone.
    keys = running(rows.select("novel_id", "pos", "origin", "verdict"), ["novel_id"], ["pos"], {"gap": ("sum", F.col("origin").isNull().cast("int"))})
    gap = F.col("gap")
    place = F.when(gap == 0, "written").when(F.col("origin").isNotNull(), "kept").when(gap == 1, "failed").otherwise("waiting")
    keys = cut(keys.select("novel_id", "pos", "verdict", place.alias("place")))
    rows = rows.join(small(keys.select("novel_id", "pos", "place"), 64), ["novel_id", "pos"])
    written = rows.where("place = 'written'")
    text = X.chapter_text(F.col("title"), F.col("paragraphs"))
    proposed = written.where("origin = 'reply' AND size(new_terms) > 0").select("novel_id", "pos", "title", "new_terms")
    proposed = proposed.join(chapters.select("novel_id", "pos", "paragraphs"), ["novel_id", "pos"]).select("novel_id", "pos", text.alias("text"), F.explode("new_terms").alias("zh", "vi"))
    proposed = proposed.where(terms.admitted_term(F.col("zh"), F.col("vi"), F.col("text"), script)).select("novel_id", F.struct("pos", "zh").alias("ord"), "zh", "vi", F.col("zh").alias("key"))
    counts = keys.groupBy("novel_id").agg(*[F.count_if(F.col("place") == p).alias(p) for p in ("written", "kept", "failed", "waiting")], F.max((F.col("place") == "failed") & (F.col("verdict") == "stop")).alias("stop"))
    status = F.when(F.col("failed") == 0, "done").when(F.col("stop"), "stopped_balance").otherwise("stopped")
    return {
        "written": written.select("novel_id", "pos", "origin", F.col("done_title").alias("title"), F.col("done").alias("paragraphs")),
        "kept": rows.where("place = 'kept'").select("novel_id", "pos", F.col("done_title").alias("title"), F.col("done").alias("paragraphs"), F.col("hash").alias("source_hash")),
        "failed": rows.where("place = 'failed'").select("novel_id", "pos", "title", "verdict"),
        "new_terms": terms.merge_new(glossary.withColumn("key", F.col("zh")), proposed).select("novel_id", F.col("ord.pos").alias("pos"), "zh", "vi"),
        "summary": counts.select("novel_id", "written", "kept", "failed", "waiting", status.alias("status")),
    }


def run_summary(summary: DataFrame) -> DataFrame:
    """(status, label, novels, failed): the outcomes of many novels' runs."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in OUTCOMES.items() for x in p]), F.col("status")), F.upper("status"))
    return summary.groupBy("status").agg(F.count("*").alias("novels"), F.sum("failed").alias("failed")).select("status", label.alias("label"), "novels", "failed")


# Books and paths
def book_pages(chapters: DataFrame) -> DataFrame:
    """(novel_id, file_name, title, content): a book's XHTML pages in order, without the title entry and copies of chapters."""
    rows = C.unique_chapters(chapters.where("NOT is_title_entry"))
    places = numbered(rows.select("novel_id", "pos").distinct(), ["novel_id"], ["pos"], "_place").select(F.col("novel_id").alias("_novel"), F.col("pos").alias("_pos"), "_place")
    rows, place = rows.join(small(places, 64), F.col("novel_id").eqNullSafe(F.col("_novel")) & F.col("pos").eqNullSafe(F.col("_pos"))), F.col("_place")
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    body = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "\n")
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), escaped(F.col("title")), F.lit("</title></head>\n<body><h1>"), escaped(F.col("title")), F.lit("</h1>\n"), body, F.lit("\n</body></html>\n"))
    return rows.select("novel_id", F.format_string("chap_%03d.xhtml", place).alias("file_name"), "title", page.alias("content"))


def book_manifest(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """(novel_id, book_id, title, author, pages, bytes, fingerprint) of each book, from its pages and profile."""
    sums = pages.groupBy("novel_id").agg(F.count("*").alias("pages"), F.sum(F.octet_length("content")).alias("bytes"), F.sum(F.xxhash64("file_name", "content").cast("decimal(38,0)")).cast("string").alias("fingerprint"))
    return profiles.select("novel_id", "book_id", "title", "author").join(sums, "novel_id")


def cache_key(path: Column) -> Column:
    """The name of a novel's cache folder: its file name in safe characters and eight digits of a hash of the whole path."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    safe = F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9_.-]+", "_"), "^[_.]+|[_.]+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("novel")), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8))


def pipeline_paths(requests: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """raw, translated, style, epub and pdf of requests (id, input, title, output_dir), files(path, identity) being there.

    A URL's raw file is named by its slug and site; an older file, by slug alone or by title, is used again only if it
    is there and holds the same source. Without an output folder everything but a given raw file goes to `base`.
    """
    given = X.strip(F.coalesce("input", F.lit("")))
    url = F.lower(given).rlike("^https?://")
    folder = F.coalesce(F.nullif(X.strip(F.coalesce("output_dir", F.lit(""))), F.lit("")), F.lit(base))
    slug, named = X.safe_name(X.guess_title(given)), X.strip(F.coalesce("title", F.lit(""))) != ""
    safe = F.when(named, X.safe_name(F.col("title"))).otherwise(slug)
    site = X.base_domain(given)
    full = F.when(given.startswith("/"), given).otherwise(F.concat(F.lit(base + "/"), given))
    rows = requests.withColumns({"_url": url, "_identity": X.source_identity(given), "_folder": folder, "_safe": safe})
    fresh = F.concat("_folder", F.lit("/"), slug, F.when(F.coalesce(site, F.lit("")) != "", F.concat(F.lit(" ("), site, F.lit(")"))).otherwise(""), F.lit("_raw.txt"))
    older = F.when(named, F.array(F.concat("_folder", F.lit("/"), slug, F.lit("_raw.txt")), F.concat("_folder", F.lit("/"), "_safe", F.lit("_raw.txt")))).otherwise(F.array(F.concat("_folder", F.lit("/"), slug, F.lit("_raw.txt"))))
    rows = rows.withColumn("_fresh", F.when(F.col("_url"), fresh).otherwise(full)).withColumn("_tries", F.when(F.col("_url"), F.concat(F.array("_fresh"), older)))
    there = files.select(F.col("path").alias("_path"), F.col("identity").alias("_of")).distinct()
    tried = rows.where("_url").select("id", "_identity", F.posexplode("_tries").alias("k", "_path")).join(there, "_path")
    found = tried.where(F.col("_identity") == F.col("_of")).groupBy("id").agg(F.min_by("_path", "k").alias("_found"))
    rows = rows.join(found, "id", "left").withColumn("raw", F.coalesce("_found", "_fresh"))
    translated = F.concat("_folder", F.lit("/"), F.element_at(F.split("raw", "/"), -1), F.lit(".viet.txt"))
    return rows.select(
        "id", "raw", translated.alias("translated"), F.concat(F.regexp_replace(translated, r"\.[^.]*$", ""), F.lit("_style.txt")).alias("style"),
        *[F.concat("_folder", F.lit("/"), "_safe", F.lit(f".{e}")).alias(e) for e in ("epub", "pdf")],
    )


def usd(amount: Column) -> Column:
    """An amount as text with two places, as in status lines."""
    return F.concat(F.lit("$"), F.format_string("%.2f", amount))
