import pytest
from pyspark.sql import functions as F

from quillspark.operators import profile

REQUEST = "path string, source_url string, title string, author string, original_title string, original_author string, genre string, publication_date string"
STORED = "path string, book_id string, created_at string, source_identity string, display_title string, display_title_origin string, author string, author_origin string, original_title string, original_author string, genre string, publication_date string"
NOW = "2026-01-02 03:04:05"


def prepared(spark, request, stored=()):
    frame = profile.prepare(spark.createDataFrame([request], REQUEST), spark.createDataFrame(list(stored), STORED), F.lit(NOW).cast("timestamp"))
    return frame.first()


def test_precedence(spark):
    url = "http://www.a.com/b/"
    first = prepared(spark, ("/x/my_book_raw.txt", url, None, " ", None, None, None, None))
    assert (first.display_title, first.display_title_origin, first.author, first.author_origin, first.created_at, first.source_identity) == ("My Book", "fallback", "Unknown", "fallback", "2026-01-02T03:04:05Z", "https://a.com/b")
    kept = tuple(first[c.split()[0]] for c in STORED.split(", "))
    second = prepared(spark, ("/x/my_book_raw.txt", url, None, None, "Source", "An", "g", None), [kept])
    assert (second.display_title, second.display_title_origin, second.author, second.book_id) == ("Source", "source", "An", first.book_id)
    manual = prepared(spark, ("/x/my_book_raw.txt", url, "Mine", None, None, None, None, None), [kept])
    again = prepared(spark, ("/x/my_book_raw.txt", url, None, None, "Source", None, None, None), [tuple(manual[c.split()[0]] for c in STORED.split(", "))])
    assert (again.display_title, again.display_title_origin) == ("Mine", "manual")
    with pytest.raises(Exception, match="another book"):
        prepared(spark, ("/x/my_book_raw.txt", "http://other.com/z", None, None, None, None, None, None), [kept])


def test_packages_and_library(spark):
    schema = "path string, size long, mtime long, sha256 string, title string, author string, metadata string"
    wanted = spark.createDataFrame([("a", 1, 1, "h", "t", "x", "m"), ("b", 1, 1, "h", "t", "x", "m"), ("c", 1, 1, "h", "t", None, "m"), ("d", 1, 1, "h", "t", "x", "m")], schema)
    receipts = spark.createDataFrame([("a", 1, 1, "h", "t", "x", "m", True), ("b", 1, 1, "h", "t2", "x", "m", True), ("c", 1, 1, "h", "t", None, "m", False)], schema + ", valid boolean")
    assert {r.path: r.rebuild for r in profile.stale_packages(wanted, receipts).collect()} == {"a": False, "b": True, "c": True, "d": True}
    due = spark.createDataFrame([("25",), ("0",), ("26",), ("x",), (None,)], "i string")
    assert [r.o for r in due.select(profile.package_due(F.col("i")).alias("o")).collect()] == [True, True, False, False, False]
    files = spark.createDataFrame([(0, "a.epub", 1, 5), (1, "a.epub", 2, 9), (1, "b.PDF", 3, 7), (0, "c.txt", 1, 8)], "folder_order int, name string, size int, mtime int")
    assert [(r.name, r.size) for r in profile.library(files, [".epub", ".pdf"]).orderBy("rank").collect()] == [("b.PDF", 3), ("a.epub", 1)]
