import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import novel_run
from quillspark.sources import books

CHAPTER = "novel_id string, pos int, title string, paragraphs array<string>, is_title_entry boolean"


def chapters(spark):
    rows = [("a", 0, "Book", [], True)] + [("a", i, f"Chương {i} <&>", [f"đoạn {i} \"x\"", "long " * 300_000 if i == 2 else "y"], False) for i in range(1, 13)]
    rows += [("a", 13, "Chương 1 <&>", ["đoạn 1 \"x\"", "y"], False), ("b/c", 1, "one", ["p"], False), (None, 1, "none", [], False)]
    return novel_run.book_pages(spark.createDataFrame(rows, CHAPTER))


def test_books_round_trip(spark, tmp_path):
    pages = chapters(spark)
    profiles = spark.createDataFrame([("a", "urn:a", "Tên & sách", "Ai"), ("x", "urn:x", "no pages", "-")], "novel_id string, book_id string, title string, author string")
    for _ in range(2):  # the second run writes over the first
        books.write_books(pages, profiles, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.epub", "b_c.epub", "null.epub"]
    got = books.read_books(spark, f"file://{tmp_path}/out")
    want = sorted((r.novel_id or "null", r.file_name, r.title, r.content) for r in pages.collect())
    assert sorted((r.file.replace("b_c", "b/c"), r.file_name, r.chapter, r.content) for r in got.collect()) == want
    assert [tuple(r) for r in got.where("file = 'a'").select("book_id", "title", "author").distinct().collect()] == [("urn:a", "Tên & sách", "Ai")]
    assert [r.file_name for r in got.where("file = 'a'").orderBy("place").collect()] == [f"chap_{i:03d}.xhtml" for i in range(1, 13)]
    with zipfile.ZipFile(tmp_path / "out" / "a.epub") as held:
        first = held.infolist()[0]
        assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED) and held.testzip() is None
    assert (tmp_path / "out" / "a.epub").read_bytes()[30:58] == b"mimetypeapplication/epub+zip"[:28]
    assert books.read_books(spark, f"file://{tmp_path}/none").count() == 0


def test_aborted_books_leave_nothing(spark, tmp_path):
    bad = F.udf(lambda c: 1 / 0 if "one" in c else c, "string")
    pages = chapters(spark)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        books.write_books(pages.withColumn("content", bad("content")), spark.createDataFrame([], "novel_id string, book_id string, title string, author string"), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_lists_of_a_book_are_not_held(tmp_path):
    """A book whose titles come to 40 MB is written and read in a part of that; of points at one page the last counts."""
    names = [x.split()[0] for x in books.WRITTEN.split(", ")]
    title = lambda i: f"{i} <&> " + "t" * 20_000

    def batches():
        for at in range(0, 2000, 50):
            rows = [("a", "urn:a", "T", "", "vi", i, f"chap_{i:04d}.xhtml", title(i), f"page {i}") for i in range(at, at + 50)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    tracemalloc.start()
    writer = books.EpubWriter(f"file://{tmp_path}/out")
    writer.commit([writer.write(batches())])
    reader, n = books.EpubReader(f"file://{tmp_path}/out"), 0
    for batch in reader.read(reader.partitions()[0]):
        for r in batch.to_pylist():
            assert (r["place"], r["file_name"], r["chapter"], r["content"], r["book_id"]) == (n + 1, f"chap_{n:04d}.xhtml", title(n), f"page {n}", "urn:a")
            n += 1
    assert n == 2000 and tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as made:
        made.writestr("EPUB/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        point = '<navPoint><navLabel><text>{}</text></navLabel><content src="a.xhtml"/>{}</navPoint>'
        made.writestr("EPUB/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{point.format("part", point.format("chapter", ""))}</navMap></ncx>')
        made.writestr("EPUB/a.xhtml", "text")
    reader = books.EpubReader(f"file://{tmp_path}")
    assert [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == [{"file": "x", "place": 1, "file_name": "a.xhtml", "chapter": "chapter", "content": "text", "book_id": "", "title": "", "author": ""}]
