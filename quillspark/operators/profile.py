"""Book profiles, package receipts and library listings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import numbered

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Fields that a source may give, and those of the package whose change calls for a new one.
SOURCE_FIELDS = ["original_title", "original_author", "genre", "publication_date"]
STAMPED = ["display_title", "author", "genre", "publication_date", "book_id"]


def _filled(c: Column) -> Column:
    return F.nullif(X.strip(F.coalesce(c, F.lit(""))), F.lit(""))


def prepare(requests: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """A profile for each request: given values win, then those set by hand before, then the source's, then a fallback.

    requests(path, source_url, title, author, and SOURCE_FIELDS of the source); stored are earlier profiles by path.
    display_title_origin and author_origin say where a value came from. A request whose source differs from the
    stored one fails. Fields that the source does not give stay as they were.
    """
    kept = ["book_id", "created_at", "source_identity", "display_title", "display_title_origin", "author", "author_origin", *SOURCE_FIELDS]
    old = stored.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in kept])
    rows = requests.join(old, F.col("path") == F.col("_path"), "left")
    identity = F.when(_filled(F.col("source_url")).isNotNull(), X.source_identity(F.col("source_url")))
    clash = identity.isNotNull() & _filled(F.col("_source_identity")).isNotNull() & (identity != F.col("_source_identity"))
    fields = {c: F.coalesce(_filled(F.col(c)), _filled(F.col(f"_{c}"))) for c in SOURCE_FIELDS}
    named = {}
    for field, given, source, fallback in (("display_title", "title", "original_title", X.guess_title(F.col("path"))), ("author", "author", "original_author", F.lit("Unknown"))):
        before = F.when(F.coalesce(F.col(f"_{field}_origin"), F.lit("manual")) == "manual", _filled(F.col(f"_{field}")))
        named[field] = F.coalesce(_filled(F.col(given)), before, fields[source], _filled(F.col(f"_{field}")), fallback)
        named[f"{field}_origin"] = F.when(_filled(F.col(given)).isNotNull() | before.isNotNull(), "manual").when(fields[source].isNotNull(), "source").otherwise("fallback")
    checked = F.when(clash, F.raise_error(F.concat(F.lit("another book is kept at "), F.col("path"))).cast("string")).otherwise(F.coalesce(identity, F.col("_source_identity")))
    return rows.select(
        "path", F.coalesce("_book_id", F.when(identity.isNotNull(), X.uuid5_url(identity)), X.uuid5_url(F.col("path"))).alias("book_id"), F.coalesce("_created_at", F.date_format(now, ISO)).alias("created_at"),
        checked.alias("source_identity"), *[v.alias(k) for k, v in {**fields, **named}.items()],
    )


def fingerprint(fields: list[str] = STAMPED) -> Column:
    """SHA-256 of the fields of a profile that a package shows."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])), 256)


def export_counts(profiles: DataFrame, raw: DataFrame, translated: DataFrame) -> DataFrame:
    """Profiles with source_chapters, exported_chapters and snapshot_complete, by path."""
    counts = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    rows = profiles.join(counts(raw, "source_chapters"), "path", "left").join(counts(translated, "exported_chapters"), "path", "left").fillna(0, ["source_chapters", "exported_chapters"])
    return rows.withColumn("snapshot_complete", (F.col("source_chapters") > 0) & (F.col("exported_chapters") >= F.col("source_chapters")))


#: The lines of a package's description.
DESCRIPTION = {"head": "Bản dịch tiếng Việt", "scope": "Phạm vi: dữ liệu đã cào, chưa xác nhận đủ toàn truyện.", "partial": "Bản dịch đang cập nhật; có thể chưa đủ chương."}
DESCRIBED = {"book_id": "ID", "exported_chapters": "Số chương đã xuất", "export_created_at": "Tạo bản xuất", "export_updated_at": "Cập nhật bản xuất"}
NAMED = {"original_title": "Tên gốc", "original_author": "Tác giả gốc", "source_url": "Nguồn", "translation_model": "Model ở lần chạy gần nhất"}


def description(profiles: DataFrame) -> Column:
    """The text that a package bears, from the columns of a profile that are there; fields without a value have no line."""
    line = lambda name, label: F.concat(F.lit(f"{label}: "), F.col(name).cast("string"))
    told = [line(k, v) for k, v in DESCRIBED.items() if k in profiles.columns]
    named = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", line(k, v)) for k, v in NAMED.items() if k in profiles.columns]
    return F.concat_ws("\n", F.lit(DESCRIPTION["head"]), *told, F.lit(DESCRIPTION["scope"]), *named, F.when(~F.coalesce("snapshot_complete", F.lit(False)), DESCRIPTION["partial"]))


def stale_packages(wanted: DataFrame, receipts: DataFrame) -> DataFrame:
    """rebuild: whether a package must be made anew: no receipt, an invalid package, or anything recorded differs.

    wanted and receipts have path, size, mtime, sha256, title, author, metadata; receipts also valid.
    """
    recorded = ["size", "mtime", "sha256", "title", "author", "metadata"]
    old = receipts.select(F.col("path").alias("_path"), "valid", *[F.col(c).alias(f"_{c}") for c in recorded])
    same = F.coalesce(F.col("valid"), F.lit(False))
    for c in recorded:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return wanted.join(old, F.col("path") == F.col("_path"), "left").select(*wanted.columns, (~same).alias("rebuild"))


def package_due(index: Column, every: int = 25) -> Column:
    """Whether a package is made after a chapter: every 25th; anything but a number is not due."""
    return F.coalesce(index.try_cast("long") % every == 0, F.lit(False))


def library(files: DataFrame, endings: list[str]) -> DataFrame:
    """Files of the listed endings, one for each name (the first folder's), newest first by rank.

    files(folder_order, name, size, mtime).
    """
    listed = files.where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*endings))
    first = listed.groupBy("name").agg(F.min_by(F.struct("size", "mtime", "folder_order"), "folder_order").alias("f")).select("name", "f.*")
    return numbered(first.withColumn("_all", F.lit(0)), ["_all"], [F.desc("mtime"), "name"], "rank").drop("_all")
