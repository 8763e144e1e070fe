"""Books as EPUB containers: a data source that writes one container for each book, in a committed step, and reads them back."""

from __future__ import annotations

import json
import sqlite3
import tempfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WRITTEN = "file string, book_id string, title string, author string, language string, place long, file_name string, chapter string, content string"
READ = "file string, place long, file_name string, chapter string, content string, book_id string, title string, author string"
#: Fixed values of the format.
MIMETYPE = "application/epub+zip"
CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
WHEN = (1980, 1, 1, 0, 0, 0)
#: Characters of a page that are given to the container at once.
PART = 1 << 20
#: Pages that are read at once.
READ_PAGES = 64
NS = {"o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "n": "http://www.daisy.org/z3986/2005/ncx/"}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Container:
    """A container that is being written: the mark of its type first and stored, pages as they come, the lists last.

    Names and titles of the pages wait in a file of the task for the lists, which are written entry by entry.
    """

    def __init__(self, sink, row: dict) -> None:
        self.zip, self.row = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), {k: row[k] for k in ("file", "book_id", "title", "author", "language")}
        self.listed, self.size = tempfile.TemporaryFile("w+", encoding="ascii"), 0
        self._put("mimetype", [MIMETYPE], zipfile.ZIP_STORED)
        self._put("META-INF/container.xml", [CONTAINER])

    def _put(self, name: str, texts: Iterable[str], kind: int = zipfile.ZIP_DEFLATED, large: bool = False) -> None:
        info = zipfile.ZipInfo(name, WHEN)
        info.compress_type = kind
        with self.zip.open(info, "w", force_zip64=large) as entry:
            for text in texts:
                for at in range(0, len(text), PART):
                    entry.write(text[at : at + PART].encode())

    def page(self, row: dict) -> None:
        content = row["content"] or ""
        self._put(f"EPUB/{row['file_name']}", [content], large=len(content) > 1 << 28)
        self.size += self.listed.write(json.dumps((row["file_name"], row["chapter"] or "")) + "\n")

    def _pages(self) -> Iterator[tuple[int, str, str]]:
        """Number, name and title of each page, escaped."""
        self.listed.seek(0)
        for i, line in enumerate(self.listed, 1):
            name, title = json.loads(line)
            yield i, escape(name), escape(title)

    def _list(self, name: str, *parts: str | Iterable[str]) -> None:
        # A page's entry has well under 64 times the bytes of its line.
        self._put(name, (x for part in parts for x in ([part] if isinstance(part, str) else part)), large=self.size > 1 << 24)

    def close(self) -> None:
        named = {k: escape(self.row[k] or "") for k in ("book_id", "title", "author", "language")}
        links = (f'<li><a href="{f}">{t}</a></li>' for _, f, t in self._pages())
        points = (f'<navPoint id="p{i}" playOrder="{i}"><navLabel><text>{t}</text></navLabel><content src="{f}"/></navPoint>' for i, f, t in self._pages())
        items = (f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f, _ in self._pages())
        spine = (f'<itemref idref="c{i}"/>' for i, _, _ in self._pages())
        self._list("EPUB/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{named["title"]}</title></head><body><nav epub:type="toc"><ol>', links, "</ol></nav></body></html>\n")
        self._list("EPUB/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{named["book_id"]}"/></head><docTitle><text>{named["title"]}</text></docTitle><navMap>', points, "</navMap></ncx>\n")
        meta = f'<dc:identifier id="id">{named["book_id"]}</dc:identifier><dc:title>{named["title"]}</dc:title><dc:creator>{named["author"]}</dc:creator><dc:language>{named["language"]}</dc:language>'
        head = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        self._list("EPUB/content.opf", head, items, '</manifest><spine toc="ncx"><itemref idref="nav"/>', spine, "</spine></package>\n")
        self.zip.close()
        self.listed.close()


@dataclass
class _Done(WriterCommitMessage):
    moves: list[tuple[str, str]]


class EpubWriter(DataSourceArrowWriter):
    """Rows of a book follow one another in a task, in the order of place; books are whole in a task.

    Containers are streamed to a folder of the job beside the target. Only the containers of tasks that the job commits
    are moved to their names, over older ones; whatever other attempts left goes with the folder.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.job = f"{self.path}/_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        files, _ = _opened(self.path)
        moves, book, sink = [], None, None
        for batch in iterator:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if book is None or book.row["file"] != row["file"]:
                    if book is not None:
                        book.close()
                        sink.close()
                    moves.append((f"{self.job}/{uuid.uuid4().hex}", f"{self.path}/{row['file']}.epub"))
                    files.create_dir(_opened(self.job)[1], recursive=True)
                    sink = files.open_output_stream(_opened(moves[-1][0])[1])
                    book = _Container(sink, row)
                book.page(row)
        if book is not None:
            book.close()
            sink.close()
        if len({target for _, target in moves}) < len(moves):
            raise ValueError("the rows of a book do not follow one another")
        return _Done(moves)

    def commit(self, messages: list[_Done | None]) -> None:
        files, _ = _opened(self.path)
        moves = [m for message in messages if message for m in message.moves]
        if len({target for _, target in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a book came out of several tasks")
        for source, target in moves:
            files.move(_opened(source)[1], _opened(target)[1])
        self.abort(messages)

    def abort(self, messages: list[_Done | None]) -> None:
        files, _ = _opened(self.path)
        folder = _opened(self.job)[1]
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


@dataclass
class _File(InputPartition):
    path: str


class EpubReader(DataSourceReader):
    """A partition for each container; pages in the order of its spine."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        files, folder = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".epub")] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _opened(self.path)
        kinds = pa.schema([(k, pa.int64() if k == "place" else pa.string()) for k in (x.split()[0] for x in READ.split(", "))])
        file = partition.path.rsplit("/", 1)[-1].removesuffix(".epub")
        with files.open_input_file(partition.path) as source, zipfile.ZipFile(source) as held:
            listed, named = _lists(held)
            pages = listed.execute("SELECT spine.idref, href, coalesce(title, '') FROM spine LEFT JOIN item ON id = idref LEFT JOIN point ON src = href WHERE idref <> 'nav' ORDER BY spine.n")
            place = 0
            while some := pages.fetchmany(READ_PAGES):
                rows = []
                for idref, name, title in some:
                    if name is None:
                        raise ValueError(f"{partition.path} lists no item {idref}")
                    place += 1
                    rows.append((file, place, name, title, held.read(f"EPUB/{name}").decode(), *named))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds, strict=True)], schema=kinds)
            listed.close()


def _lists(held: zipfile.ZipFile) -> tuple[sqlite3.Connection, list[str]]:
    """What a container lists, in a file of the task: item(id, href), spine(n, idref), point(src, title, n); and the book's id, title and creator.

    Of several points at a page the last one counts.
    """
    listed = sqlite3.connect("")  # a file of its own that goes when it is closed
    listed.executescript("CREATE TABLE item (id TEXT PRIMARY KEY, href TEXT); CREATE TABLE spine (n INTEGER PRIMARY KEY, idref TEXT); CREATE TABLE point (src TEXT PRIMARY KEY, title TEXT, n INTEGER)")
    put = "INSERT INTO point VALUES (?, ?, ?) ON CONFLICT (src) DO UPDATE SET title = excluded.title, n = excluded.n WHERE excluded.n > point.n"
    tags = {k: f"{{{NS[k[0]]}}}{k[1:]}" for k in ("ometadata", "oitem", "oitemref", "nnavPoint", "didentifier", "dtitle", "dcreator")}
    named: dict[str, str] = {}
    for n, above, x in _elements(held, "EPUB/content.opf", {tags["oitem"], tags["oitemref"]}):
        if x.tag == tags["oitem"]:
            listed.execute("INSERT OR REPLACE INTO item VALUES (?, ?)", (x.get("id"), x.get("href")))
        elif x.tag == tags["oitemref"]:
            listed.execute("INSERT INTO spine VALUES (?, ?)", (n, x.get("idref")))
        elif above is not None and above.tag == tags["ometadata"]:
            named.setdefault(x.tag, x.text or "")
    for n, _, x in _elements(held, "EPUB/toc.ncx", {tags["nnavPoint"]}):
        if x.tag == tags["nnavPoint"] and x.find("n:content", NS) is not None:
            listed.execute(put, (x.find("n:content", NS).get("src"), x.findtext("n:navLabel/n:text", "", NS), n))
    return listed, [named.get(tags[f"d{k}"], "") for k in ("identifier", "title", "creator")]


def _elements(held: zipfile.ZipFile, name: str, dropped: set[str]) -> Iterator[tuple[int, ET.Element | None, ET.Element]]:
    """(number, parent, element) at each element's end, numbered by their starts; those of the dropped tags are then let go."""
    open_: list[tuple[int, ET.Element]] = []
    with held.open(name) as source:
        n = 0
        for event, x in ET.iterparse(source, ("start", "end")):
            if event == "start":
                n += 1
                open_.append((n, x))
                continue
            number, _ = open_.pop()
            above = open_[-1][1] if open_ else None
            yield number, above, x
            if x.tag in dropped and above is not None:
                above.remove(x)


class EpubDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options["path"])


def write_books(pages: DataFrame, profiles: DataFrame, path: str) -> None:
    """A container in the folder for each novel of pages (novel_id, file_name, title, content), named by its id.

    profiles(novel_id, book_id, title, author) name the books; a novel without one has empty names and its id for
    book_id. Pages follow by the number in their file name. Each book is written by one task, page by page.
    """
    pages.sparkSession.dataSource.register(EpubDataSource)
    named = profiles.select(F.col("novel_id").alias("_novel"), "book_id", F.col("title").alias("_title"), "author")
    file = F.regexp_replace(F.coalesce(F.col("novel_id").cast("string"), F.lit("null")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    rows = pages.join(named, F.col("novel_id").eqNullSafe(F.col("_novel")), "left").select(
        file.alias("file"), F.coalesce(F.col("book_id").cast("string"), F.col("novel_id").cast("string")).alias("book_id"), F.coalesce("_title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"),
        F.lit("vi").alias("language"), F.regexp_extract("file_name", "([0-9]+)", 1).try_cast("long").alias("place"), "file_name", F.col("title").alias("chapter"), "content",
    )
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "file").sortWithinPartitions("file", "place", "file_name").write.format("epub").mode("append").save(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, file_name, chapter, content, book_id, title, author): the pages of all containers of a folder."""
    spark.dataSource.register(EpubDataSource)
    return spark.read.format("epub").load(path)
