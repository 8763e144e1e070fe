"""Crawl bookkeeping as data: resuming in catalogues, runs of missing pages, and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import cut, groups_fit, numbered, running

#: Chapters looked back over for overlaps, and missing pages in a row that end a crawl.
OVERLAP, TOLERANCE = 20, 3
#: Fixed value: pages that a search for a chapter looks at.
PROBES = 12


def resume_index(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """(book_id, next_index): where to go on in each catalogue (ord from 0).

    state(book_id, existing, last_url, last_title). By the last URL; else, of entries with the last title, or else its
    number, the one nearest to the number of existing chapters (the earlier of equals); else the number itself.
    """
    title, number = X.norm_title(F.col("last_title")), X.chapter_number(F.col("last_title"))
    joined = state.join(catalog.select("book_id", "ord", "url", "title"), "book_id", "left")
    near = F.struct(F.abs(F.col("ord") - (F.col("existing") - 1)), F.col("ord"))
    by_url = F.when((F.coalesce("last_url", F.lit("")) != "") & (X.url_key(F.col("url")) == X.url_key(F.col("last_url"))), F.col("ord"))
    found = joined.groupBy("book_id").agg(
        F.first("existing").alias("existing"), F.min(by_url).alias("by_url"),
        F.min(F.when((title != "") & (X.norm_title(F.col("title")) == title), near)).alias("by_title"),
        F.min(F.when(X.chapter_number(F.col("title")) == number, near)).alias("by_number"),
    )
    index = F.coalesce(F.col("by_url") + 1, F.col("by_title.ord") + 1, F.col("by_number.ord") + 1, F.col("existing"))
    return found.select("book_id", F.when(F.col("existing") > 0, index).otherwise(0).alias("next_index"))


def from_number(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(book_id, wanted, next_index): the first entry whose number is at least the wanted one.

    Past all numbers it is the catalogue's length; in catalogues without numbers, the wanted number less one. Entries
    are only counted and compared: for each book and wanted number a minimum, combined in each task.
    """
    entries = catalog.select("book_id", "ord", X.chapter_number(F.col("title")).alias("number"))
    sizes = entries.groupBy("book_id").agg(F.count("*").alias("size"), F.count("number").alias("numbers"))
    asked = wanted.select("book_id", "wanted").distinct()
    first = entries.where("number IS NOT NULL").join(asked, "book_id").where("number >= wanted").groupBy("book_id", "wanted").agg(F.min("ord").alias("first"))
    found = wanted.join(sizes, "book_id").join(first, ["book_id", "wanted"], "left")
    return found.select("book_id", "wanted", F.when(F.col("numbers") == 0, F.col("wanted") - 1).otherwise(F.coalesce("first", "size")).cast("long").alias("next_index"))


def forward_asof(left: DataFrame, right: DataFrame, group: list[str], at: str, place: str) -> DataFrame:
    """next_place: the least place of the group that is not before `at`, by one sorted pass over both tables.

    Both sides are laid into one falling order, and the last right row so far is the next one: a running value, so
    that a group of any size is passed once and no pair is formed.
    """
    both = left.select("*", F.col(at).alias("_at"), F.lit(0).alias("_side")).unionByName(right.select(*group, F.col(place).alias("_at"), F.lit(1).alias("_side")), allowMissingColumns=True)
    out = running(both, group, [F.desc("_at"), F.desc("_side")], {"next_place": ("last", F.when(F.col("_side") == 1, F.col("_at")))})
    return out.where("_side = 0").drop("_at", "_side")


def already_saved(title: Column, last_title: Column) -> Column:
    """Whether a chapter found on resuming is one of the last 20 saved."""
    number, last = X.chapter_number(title), X.chapter_number(last_title)
    same = (X.norm_title(title) != "") & (X.norm_title(title) == X.norm_title(last_title))
    return same | F.coalesce((number > last - OVERLAP) & (number <= last), F.lit(False))


def stop_runs(log: DataFrame, group: list[str], order: str, status: str, tolerance: int = TOLERANCE) -> DataFrame:
    """run and stopped: the length of the run of equal not-ok states so far, and whether one has been too long."""
    small_groups = groups_fit(log, group)
    rows = running(numbered(log, group, [order], "_n", small_groups=small_groups), group, [order], {"_was": ("last", F.col(status))}, before=True, small_groups=small_groups)
    rows = running(rows, group, [order], {"_start": ("max", F.when(~F.col(status).eqNullSafe(F.col("_was")), F.col("_n")))}, small_groups=small_groups)
    rows = rows.withColumn("run", F.when(F.col(status) == "ok", 0).otherwise(F.col("_n") - F.col("_start") + 1))
    rows = running(rows, group, [order], {"_over": ("max", (F.col("run") > tolerance).cast("int"))}, small_groups=small_groups)
    return rows.withColumn("stopped", F.col("_over") > 0).drop("_n", "_was", "_start", "_over")


def locate_page(pages: DataFrame, wanted: DataFrame, most: int = PROBES) -> DataFrame:
    """(book_id, wanted, page, probes): where the chapter with the wanted number is, by looking at single pages.

    pages(book_id, page, number) are the pages that exist; number is null for notices. wanted(book_id, wanted,
    saved_page, saved_number) may name a page whose number is known, from which the first guess is shifted. A page with
    another number moves the guess by the difference, a notice by one page forward, a missing page forward too, or back
    once a greater number has been seen. The search ends at the wanted number, at a page seen before, before the first
    page, or after `most` looks; then the page with the least greater number seen counts, else the wanted number.

    Each round is one join of the open searches, which are narrow rows, with the pages; there are `most` at most, and
    what is open is written after every fourth.
    """
    there = pages.select(F.col("book_id").alias("_book"), F.col("page").cast("long").alias("_page"), F.col("number").cast("long").alias("number")).groupBy("_book", "_page").agg(F.min("number").alias("number"))
    guess = F.col("wanted") + F.coalesce(F.col("saved_page") - F.col("saved_number"), F.lit(0))
    none = F.lit(None).cast("long")
    open_ = wanted.select("book_id", F.col("wanted").cast("long").alias("wanted"), guess.cast("long").alias("page"), F.array().cast("array<long>").alias("seen"), none.alias("after_number"), none.alias("after_page"), none.alias("found"))
    ended = []
    for look in range(1, most + 1):
        stop = F.col("found").isNotNull() | (F.col("page") < 1) | F.array_contains("seen", F.col("page"))
        ended.append(open_.where(stop))
        met = open_.where(~stop).join(there, (F.col("book_id") == F.col("_book")) & (F.col("page") == F.col("_page")), "left")
        nearer = F.col("number").isNotNull() & (F.col("number") > F.col("wanted")) & (F.col("after_number").isNull() | (F.col("number") < F.col("after_number")))
        met = met.withColumns({"after_page": F.when(nearer, F.col("page")).otherwise(F.col("after_page")), "after_number": F.when(nearer, F.col("number")).otherwise(F.col("after_number"))})
        step = F.when(F.col("_page").isNull(), F.when(F.col("after_number").isNotNull(), -1).otherwise(1)).when(F.col("number").isNull(), 1).otherwise(F.col("wanted") - F.col("number"))
        met = met.withColumn("found", F.when(F.col("number") == F.col("wanted"), F.col("page")))
        open_ = met.select("book_id", "wanted", (F.col("page") + step).alias("page"), F.concat("seen", F.array("page")).alias("seen"), "after_number", "after_page", "found")
        open_ = cut(open_) if look % 4 == 0 else open_
    rows = reduce(DataFrame.unionByName, [*ended, open_])
    return rows.select("book_id", "wanted", F.coalesce("found", "after_page", "wanted").alias("page"), F.size("seen").cast("long").alias("probes"))


def resume_number(last_url: Column, base: Column, suffix: Column, existing: Column, url_number: Column) -> Column:
    """One past the number of the last URL with the same base and suffix, else past the existing, else the URL's own."""
    middle = F.when(last_url.startswith(base) & last_url.endswith(suffix), F.substring(last_url, F.length(base) + 1, F.length(last_url) - F.length(base) - F.length(suffix)))
    return F.coalesce(middle.try_cast("long") + 1, F.when(existing > 0, existing + 1), url_number)


def next_page(links: DataFrame, group: list[str]) -> DataFrame:
    """The link to go on with: rel=next first, then the least page number and path, of those beyond the current page."""
    ahead = links.where(F.col("page") > F.col("current"))
    best = ahead.groupBy(*group).agg(F.min(F.struct(F.when(F.col("rel") == "next", 0).otherwise(1).alias("p"), "page", "path")).alias("best"))
    return best.select(*group, "best.page", "best.path")


def before_stop(events: DataFrame, group: list[str], order: str, stop: Column) -> DataFrame:
    """Rows before the first stop of their group: a minimum joined back, no sort of a group."""
    first = events.where(stop).groupBy(*group).agg(F.min(order).alias("_stop")) if group else events.where(stop).agg(F.min(order).alias("_stop"))
    joined = events.join(first, group, "left") if group else events.crossJoin(first)
    return joined.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
