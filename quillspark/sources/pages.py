"""Saved pages: routing by host, chapter text and book metadata out of HTML.

Markup is parsed in Arrow batches by the standard library's parser, which takes broken nesting as it comes; what the
fields mean is decided by DataFrame expressions afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quillspark.functions import text as X
from quillspark.functions.tables import cut, numbered
from quillspark.sources.dictionaries import last_wins

# Hosts, catalogue and chapter paths of the sites, and where each site keeps titles and text.
SITES = {
    "uukanshu": {"hosts": ["uukanshu.cc"], "book": r"^/book/(\d+)/?", "chapter": r"^/book/\d+/(\d+)\.html$", "title": ["h1.pt10"], "body": ["div.readcotent"]},
    "bgq99": {"hosts": ["bgq99.cc"], "book": r"^/(?:html/)?(\d+)/?", "chapter": r"/(\d+)\.html$", "title": ["h1"], "body": ["div#content.showtxt", "div#content", "div.showtxt"]},
    "69shuba": {"hosts": ["69shuba.com", "69shuba.cx"], "book": r"^/(?:txt|book)/(\d+)", "chapter": r"^/txt/\d+/(\d+)", "title": ["h1"], "body": ["div.txtnav"]},
    "shubaow": {"hosts": ["shubaow.net"], "book": r"^/(?:\d+_)?(\d+)/?", "chapter": r"/(\d+)\.html$", "title": ["h1"], "body": ["div#htmlContent"]},
    "biquge": {"hosts": ["biquge.tw"], "book": r"^/book/(\d+)", "chapter": r"/(\d+)(?:_\d+)?\.html$", "title": ["h1"], "body": ["div#chaptercontent", "div.content"]},
    "tianyabooks": {"hosts": ["tianyabooks.com"], "book": r"^/(?:book/)?([a-z0-9-]+)/?", "chapter": r"/([^/]+)\.html$", "title": ["h1"], "body": ["div#main", "div.content"]},
}
TITLES = ["div.title", "h1", ".chapter-title"]
BODIES = ["div.showtxt#content", "div.showtxt", "div#neirong", "div.neirong", "div#chaptercontent", "div.read-content", "div#htmlContent", "div.read-content-body", "div.txtnav", "div.readcotent", "div.content", "#content", ".chapter-content", "article"]
UNWANTED = ["script", "style", "noscript", "nav", "iframe", ".mobadsq", ".anchor_bookmark", ".textinfo", ".page_chapter", ".txtinfo", "#txtright", ".bottom-ad", ".contentadv", "h1"]
BOOK = "div.info"
# Fixed values of dictionary pages: the head of an entry's name, its meaning, links to entries, placeholders among them,
# and the credit behind a meaning.
CRUMB, LEAD = "Đang xem mục từ:", "p.lead"
ENTRY, PLACEHOLDERS = r"^tu-dien_han-viet_(\w+)_rong-mo-tam-hon\.html", ["none", "lgddsssc"]
CREDIT = r"\s*\([^)]*Từ điển[^)]*\)\s*$"
# Fixed values of catalogue pages: what names the author before a colon, and classes of elements that hold the name.
CREDITS, AUTHORS, COLON = ["作者", "author"], {"book-author", "author"}, set(":：")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Rows whose values a Python worker holds as objects at once.
ROWS = 64
#: What the parser gives for a page.
FIELDS = {
    "title": "string", "book": "string", "paragraphs": "array<string>", "lines": "array<string>", "meta": "map<string,string>", "ld": "array<string>",
    "links": "array<struct<href:string,text:string,rel:string,number:string>>", "found": "boolean", "lead": "string", "crumb": "string", "heading": "string", "author": "string", "credits": "array<string>",
}


class _Tree(HTMLParser):
    """Elements as [tag, attributes, children]; children are elements or strings. An end tag closes up to its start."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _selector(text: str) -> tuple[str, str, list[str]]:
    """Tag, id and classes of a compound selector."""
    parts = re.findall(r"([.#]?)([\w-]+)", text)
    pick = lambda kind: [v for k, v in parts if k == kind]
    return "".join(pick("")), "".join(pick("#")), pick(".")


# Parsed once; a plain table, so that it travels to the executors with the functions that read it.
_SELECTORS = {s: _selector(s) for rule in SITES.values() for s in rule["title"] + rule["body"]} | {s: _selector(s) for s in [*TITLES, *BODIES, *UNWANTED, BOOK, LEAD]}


def _fits(node: list, selector: str) -> bool:
    """One compound selector: a tag, #id and .class parts."""
    tag, name, classes = _SELECTORS[selector]
    if tag and node[0] != tag or name and node[1].get("id") != name:
        return False
    return not classes or "class" in node[1] and all(c in node[1]["class"].split() for c in classes)


def _all(node: list):
    stack = [c for c in reversed(node[2]) if isinstance(c, list)]
    while stack:
        at = stack.pop()
        yield at
        stack += [c for c in reversed(at[2]) if isinstance(c, list)]


def _strings(node: list, skip: list[str] = ()) -> list[str]:
    out, stack = [], list(reversed(node[2]))
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        elif not any(_fits(at, s) for s in skip):
            stack += reversed(at[2])
    return out


def _first(nodes: list[list], selectors: list[str]) -> list | None:
    """The first node that fits the first selector that any fits, in one walk: what is found is only bettered."""
    best, rank = None, len(selectors)
    for n in nodes:
        for i in range(rank):
            if _fits(n, selectors[i]):
                best, rank = n, i
                break
        if not rank:
            break
    return best


# Unwanted elements are named by one tag, id or class each.
_UNWANTED = [{s.lstrip(kind) for s in UNWANTED if (s[0] if s[0] in "#." else "") == kind} for kind in ("", "#", ".")]


def _unwanted(node: list) -> bool:
    tags, names, classes = _UNWANTED
    return node[0] in tags or node[1].get("id") in names or "class" in node[1] and not classes.isdisjoint(node[1]["class"].split())


def _links(tree: list) -> list[dict]:
    """Links in order, with the number that the list item around them bears."""
    out, stack = [], [(c, None) for c in reversed(tree[2]) if isinstance(c, list)]
    while stack:
        n, number = stack.pop()
        if n[0] == "a" and n[1].get("href"):
            out.append({"href": n[1]["href"], "text": _joined(_strings(n)), "rel": n[1].get("rel", ""), "number": number})
        number = n[1].get("data-num") if n[0] == "li" else number
        stack += [(c, number) for c in reversed(n[2]) if isinstance(c, list)]
    return out


def _joined(strings: list[str], by: str = " ") -> str:
    return by.join(s for s in (x.strip() for x in strings) if s)


def _page(html: str, titles: list[str], bodies: list[str], wanted: list[str] | None = None) -> dict:
    """The wanted fields of a page (all, if none are named), from one list of its elements."""
    tree = _Tree(html).root
    nodes = list(_all(tree))
    title, body = _first(nodes, titles), _first(nodes, bodies)

    def book() -> str:
        info = _first(nodes, [BOOK])
        named = next((n for n in _all(info) if n[0] == "a"), None) if info else None
        head = None if named or title else next((n for n in nodes if n[0] == "title"), None)
        return _joined(_strings(named or head)) if named or head else ""

    def text() -> tuple[list[str] | None, list[str]]:
        if not body:
            return None, []
        clean = ["", {}, _without(body)]
        found = [n for n in _all(clean) if n[0] == "p"]
        whole = found and not (len(found) == 1 and any(n[0] == "br" for n in _all(found[0])))
        return ([_joined(_strings(n)) for n in found] or None) if whole else None, _joined(_strings(clean), "\n").splitlines()

    held = text() if wanted is None or "lines" in wanted else (None, [])
    fields = {
        "title": lambda: _joined(_strings(title)) if title else "", "book": book, "paragraphs": lambda: held[0], "lines": lambda: held[1], "found": lambda: body is not None,
        "meta": lambda: {n[1].get("property") or n[1].get("name"): n[1]["content"].strip() for n in reversed(nodes) if n[0] == "meta" and n[1].get("content", "").strip() and (n[1].get("property") or n[1].get("name"))},
        "ld": lambda: ["".join(x for x in n[2] if isinstance(x, str)) for n in nodes if n[0] == "script" and n[1].get("type") == "application/ld+json"],
        "links": lambda: _links(tree),
        "lead": lambda: next((_joined(_strings(n)) for n in nodes if _fits(n, LEAD)), None), "crumb": lambda: next((x for x in _strings(tree) if CRUMB in x), None),
        "heading": lambda: next((_joined(_strings(n)) for n in nodes if n[0] == "h1"), None),
        "author": lambda: next((_joined(_strings(n)) for n in nodes if n[1].get("itemprop") == "author" or not AUTHORS.isdisjoint(n[1].get("class", "").split())), None),
        "credits": lambda: [x for x in (y.strip() for t in _strings(tree) for y in t.splitlines()) if COLON & set(x[:40])],
    }
    return {k: make() for k, make in fields.items() if wanted is None or k in wanted}


def _without(node: list) -> list:
    """The children of a node without unwanted elements, at any depth of nesting."""
    out: list = []
    stack = [(node, out)]
    while stack:
        at, kept = stack.pop()
        for c in at[2]:
            if isinstance(c, str):
                kept.append(c)
            elif not _unwanted(c):
                kept.append([c[0], c[1], []])
                stack.append((c, kept[-1][2]))
    return out


def rowwise(function: Callable, kind: str) -> Callable[..., Column]:
    """function over the values of Arrow columns, row by row; no more than ROWS rows are Python objects at once."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def one(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for at in range(0, len(column), ROWS):
                yield pa.array([function(v) for v in column.slice(at, ROWS).to_pylist()], arrow)

    def many(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for held in columns:
            for at in range(0, len(held[0]), ROWS):
                yield pa.array([function(*v) for v in zip(*(c.slice(at, ROWS).to_pylist() for c in held), strict=True)], arrow)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else many, kind, ArrowUDFType.SCALAR_ITER)(*columns)


def site(url: Column) -> Column:
    """The site of a URL by its host, with or without www., m. and wx.; null for other hosts."""

    def named(bare: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, rule in SITES.items():
            out = F.when(bare.isin(*rule["hosts"]), name).otherwise(out)
        return out

    return X.let(F.regexp_replace(X.host(url), r"^(www|m|wx)\.", ""), named)


def url_ids(url: Column) -> Column:
    """A struct of book and chapter id by the site's path patterns; null where a pattern does not fit."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    pick = lambda x, part: F.coalesce(*[F.when(x["site"] == name, F.nullif(F.regexp_extract(x["path"], rule[part], 1), F.lit(""))) for name, rule in SITES.items()])
    return X.let(F.struct(site(url).alias("site"), path.alias("path")), lambda x: F.struct(pick(x, "book").alias("book"), pick(x, "chapter").alias("chapter")))


def parse_markup(pages: DataFrame, html: str = "html", at: str = "site", fields: list[str] | None = None) -> DataFrame:
    """pages with a struct column `page` of what the markup holds, all of FIELDS or those named; null html is empty."""
    kinds = {n: t for n, t in FIELDS.items() if fields is None or n in fields}

    def parse(markup: str | None, name: str | None) -> dict:
        rule = SITES.get(name, {})
        page = _page(markup or "", rule.get("title", []) + TITLES, rule.get("body", []) + BODIES, list(kinds))
        return page | {"meta": list(page["meta"].items())} if "meta" in page else page

    return pages.withColumn("page", rowwise(parse, "struct<" + ",".join(f"`{n}`:{t}" for n, t in kinds.items()) + ">")(F.col(html), F.col(at)))


def chapters_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, site, status, title, paragraphs): status ok, challenge, no_content or too_short (under 20 characters).

    Paragraphs are cleaned, advertisement lines dropped, and a first paragraph equal to the title left out.
    """
    rows = parse_markup(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), site(F.col(url)).alias("site")), fields=["title", "book", "paragraphs", "lines", "found"])
    title, book = X.clean_chapter_title(F.col("page.title")), X.clean_text(F.col("page.book"))
    title = F.when((book != "") & title.startswith(F.concat(book, F.lit(" "))), X.strip(F.substring(title, F.length(book) + 1, 1 << 30))).when(title == "", X.clean_chapter_title(F.col("page.book"))).otherwise(title)
    rows = rows.withColumn("title", title).withColumn("parts", F.filter(F.transform(F.coalesce("page.paragraphs", "page.lines"), X.clean_text), lambda p: (p != "") & ~X.is_ad(p)))
    rows = rows.select("key", "site", "html", "page", "title", "parts", F.aggregate("parts", F.lit(0), lambda s, p: s + F.length(p)).alias("size"))
    parts = F.when(F.try_element_at("parts", F.lit(1)) == F.col("title"), F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))).otherwise(F.col("parts"))
    size = F.col("size")
    status = F.when(X.is_challenge(F.col("html")), "challenge").when(~F.col("page.found"), "no_content").when(size < 20, "too_short").otherwise("ok")
    return rows.withColumn("parts", parts).select(F.col("key").alias(key), "site", status.alias("status"), "title", F.when(status == "ok", F.col("parts")).alias("paragraphs"))


def join_chapter_pages(parts: DataFrame) -> DataFrame:
    """(book, chapter, status, paragraphs) from pages (book, chapter, page, last, status, paragraphs) of chapters.

    A chapter whose pages are not 1 to its last page, all ok, is to be fetched again.
    """
    got = parts.groupBy("book", "chapter").agg(F.sort_array(F.collect_list(F.struct("page", "paragraphs"))).alias("p"), F.min((F.col("status") == "ok").cast("int")).alias("ok"), F.max("last").alias("last"), F.max("page").alias("top"), F.count_distinct("page").alias("n"))
    whole = (F.col("ok") == 1) & (F.col("top") == F.col("last")) & (F.col("n") == F.col("last"))
    return got.select("book", "chapter", F.when(whole, "ok").otherwise("retry").alias("status"), F.when(whole, F.flatten(F.transform("p", lambda x: x["paragraphs"]))).alias("paragraphs"))


def is_catalogue(url: Column) -> Column:
    """Whether a URL names a book of a known site and none of its chapters."""
    ids = url_ids(url)
    return ids["book"].isNotNull() & ids["chapter"].isNull()


def catalogue(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, ord, url, title): links of a page to chapters of its book, first of each URL, titles not empty.

    Where all list items bear a number, links follow by it; where only some do and the first has a greater one than
    the last, the list is turned round; else the order is the page's.
    """
    rows = parse_markup(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), site(F.col(url)).alias("site")), fields=["links"])
    links = rows.select("key", "url", F.posexplode("page.links").alias("n", "l"))
    root = F.concat(F.try_parse_url(F.col("url"), F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(F.col("url"), F.lit("HOST")))
    full = F.when(F.col("l.href").rlike("^https?://"), F.col("l.href")).when(F.col("l.href").startswith("/"), F.concat(root, F.col("l.href"))).otherwise(F.concat(F.regexp_replace("url", "[^/]*$", ""), F.col("l.href")))
    links = links.withColumns({"full": X.url_key(full), "title": X.clean_text(F.col("l.text")), "number": X.strip(F.col("l.number")).try_cast("long")}).where("title != ''")
    links = links.where(url_ids(F.col("full"))["chapter"].isNotNull() & url_ids(F.col("full"))["book"].eqNullSafe(url_ids(F.col("url"))["book"]))
    links = cut(links.select("key", "n", "full", "title", "number"))  # read twice below: the pages are parsed once
    ends = links.groupBy(F.col("key").alias("_key")).agg((F.count("number") == F.count("*")).alias("by_number"), (F.min_by("number", "n") > F.max_by("number", "n")).alias("falling"))
    links = links.join(ends, F.col("key").eqNullSafe(F.col("_key")))
    place = F.when(F.col("by_number"), F.struct("number", F.col("n").cast("long").alias("n"))).otherwise(F.struct(F.lit(0).cast("long").alias("number"), F.when(F.coalesce("falling", F.lit(False)), -F.col("n")).otherwise(F.col("n")).cast("long").alias("n")))
    first = links.groupBy("key", "full").agg(F.min(F.struct(place.alias("place"), "title")).alias("m")).select(F.col("key").alias(key), F.col("m.place").alias("place"), F.col("full").alias("url"), F.col("m.title").alias("title"))
    return numbered(cut(first), [key], ["place"]).select(key, (F.col("number") - 1).cast("int").alias("ord"), "url", "title")


def start_index(listed: DataFrame, starts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, start_url, ord): the place in catalogue() of the chapter that a URL names, 0 if it names none or it is not listed."""
    wanted = starts.select(key, "start_url", url_ids(F.col("start_url")).alias("_ids"))
    there = listed.select(F.col(key).alias("_key"), url_ids(F.col("url")).alias("_of"), "ord")
    met = wanted.join(there, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_ids.book") == F.col("_of.book")) & (F.col("_ids.chapter") == F.col("_of.chapter")), "left")
    return met.groupBy(key, "start_url").agg(F.coalesce(F.min("ord"), F.lit(0)).alias("ord"))


def book_metadata(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", catalog: Column | None = None) -> DataFrame:
    """(key, original_title, original_author, genre, publication_date): meta tags first, then JSON-LD books.

    On catalogue pages, by default those whose URL is one, a missing title is og:title or else the first heading, and a
    missing author the text of the element for it or else a short line that names it. Dates that are no dates, as a
    whole, are dropped. Pages that are challenges have nothing.
    """
    wide = is_catalogue(F.col(url)) if catalog is None else catalog
    rows = parse_markup(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), site(F.col(url)).alias("site"), F.coalesce(wide, F.lit(False)).alias("wide")), fields=["meta", "ld", "heading", "author", "credits"])
    tag = lambda *names: F.coalesce(*[F.try_element_at("page.meta", F.lit(n)) for n in names])
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    kinds = "array<struct<`@type`:string,name:string,datePublished:string,author:string>>"
    items = F.flatten(F.transform("page.ld", lambda j: F.coalesce(F.from_json(F.when(X.strip(j).startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]"))), kinds), F.array().cast(kinds))))
    told = F.filter(items, lambda x: x["@type"].isin("Book", "Novel"))
    first = lambda of: F.try_element_at(F.filter(F.transform(told, of), lambda v: v.isNotNull() & (v != "")), F.lit(1))
    person = lambda x: F.when(x["author"].rlike(r"^\s*\["), F.coalesce(F.get_json_object(x["author"], "$[0].name"), F.when(~F.get_json_object(x["author"], "$[0]").startswith("{"), F.get_json_object(x["author"], "$[0]")))).when(x["author"].rlike(r"^\s*\{"), F.get_json_object(x["author"], "$.name")).otherwise(x["author"])
    head = lambda line: F.lower(F.regexp_replace(F.split(line, "[:：]", 2)[0], r"(?U)\s+", ""))
    rest = lambda line: X.strip(F.split(line, "[:：]", 2)[1])
    line = F.try_element_at(F.transform(F.filter("page.credits", lambda x: head(x).isin(*CREDITS) & F.length(rest(x)).between(1, 80)), rest), F.lit(1))
    author = F.coalesce(given(tag("og:novel:author", "book:author", "author", "novel:author")), first(person), F.when(F.col("wide"), F.coalesce(given(F.col("page.author")), line)), F.lit(""))
    author = X.let(author, lambda a: F.when(a.rlike("[:：]") & head(a).isin(*CREDITS), rest(a)).otherwise(X.strip(a)))
    when = F.coalesce(given(tag("book:release_date", "og:novel:publication_date")), first(lambda x: x["datePublished"]), F.lit(""))
    whole = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    date = F.when(when.rlike(whole) & F.left(when, F.lit(10)).try_cast("date").isNotNull() & F.regexp_replace(when, ",", ".").try_cast("timestamp").isNotNull(), when).otherwise("")
    title = F.coalesce(given(tag("og:novel:book_name", "book_name", "novel:book_name")), first(lambda x: x["name"]), F.when(F.col("wide"), F.coalesce(given(tag("og:title")), F.col("page.heading"))), F.lit(""))
    empty = X.is_challenge(F.col("html"))
    plain = lambda c: F.when(empty, "").otherwise(X.strip(c))
    return rows.select(F.col("key").alias(key), plain(title).alias("original_title"), plain(author).alias("original_author"), plain(F.coalesce(tag("og:novel:category"), F.lit(""))).alias("genre"), plain(date).alias("publication_date"))


def save_pages(pages: DataFrame, folder: str, key: str = "page_id", value: str = "value") -> int:
    """The number of files written: a file "<row>-<key name>=<key>.html" for each row in a folder of its task, its value and a line break.

    Files are written under another name and then moved, so that a task run again writes over what it left. There is one
    folder for each task, not one for each page, and nothing that the driver would have to move page by page.
    """
    home = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, place = fs.FileSystem.from_uri(home) if "://" in home or home.startswith("file:") else (fs.LocalFileSystem(), home)
        place, n = f"{place}/part-{TaskContext.get().partitionId():05d}", 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                if not n:
                    files.create_dir(place, recursive=True)
                for row in batch.slice(at, ROWS).to_pylist():
                    name = f"{n}-{key}={row['key']}.html"
                    waiting = f"{place}/_{TaskContext.get().taskAttemptId()}-{name}"
                    with files.open_output_stream(waiting) as sink:
                        sink.write(((row["value"] or "") + "\n").encode())
                    files.move(waiting, f"{place}/{name}")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return pages.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, url, html) of the files of a folder, HTML or MHTML, of any encoding that decoded() knows.

    Spark's own reader plans the files into partitions and leaves the contents unread where only paths are asked for.
    The URL is the one that an MHTML file or a saved page's first comment names, else null. Empty files give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    start = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    wrapped = start.rlike(r"(?is)^\s*(from|mime-version|snapshot-content-location|content-type):.*multipart/related")
    named = F.coalesce(F.nullif(F.regexp_extract(start, r"(?im)^snapshot-content-location:\s*(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract(start, r"saved from url=\(\d+\)(\S+)", 1), F.lit("")))
    return files.select("path", named.alias("url"), F.when(wrapped, mhtml_part(F.when(wrapped, F.col("content")))).otherwise(decoded(F.when(~wrapped, F.col("content")))).alias("html"))


def dictionary_entries(saved: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(word, meaning) of saved dictionary pages, the last page of a word counts.

    The word follows " - " in the name of the entry, which stands in the page's JSON-LD or else in its text; the meaning
    is the lead without the credit at its end. Pages without either, and null html, give no row.
    """
    rows = parse_markup(saved.select(F.col(key).alias("key"), F.col(html).alias("html"), F.lit(None).cast("string").alias("site")), fields=["ld", "crumb", "lead"])
    listed = F.filter(F.transform("page.ld", lambda j: F.regexp_extract(j, rf'"name"\s*:\s*"{CRUMB}\s*([^"]+)"', 1)), lambda x: x != "")
    shown = F.regexp_extract(F.coalesce("page.crumb", F.lit("")), rf'{CRUMB}\s*([^»"]+)', 1)
    name = X.strip(F.coalesce(F.try_element_at(listed, F.lit(1)), shown))
    parts = F.split(name, " - ", 2)
    word, meaning = X.strip(F.coalesce(F.try_element_at(parts, F.lit(2)), name)), X.strip(F.regexp_replace("page.lead", CREDIT, ""))
    found = rows.select("key", word.alias("word"), meaning.alias("meaning")).where("word != '' AND meaning != ''")
    return last_wins(found, "word", "key").select("word", "meaning")


def entry_slugs(saved: DataFrame, html: str = "html") -> DataFrame:
    """(slug): entries that saved lists of a dictionary link to, each once, placeholders left out."""
    rows = parse_markup(saved.select(F.col(html).alias("html"), F.lit(None).cast("string").alias("site")), fields=["links"])
    slug = rows.select(F.explode("page.links.href").alias("href")).select(F.regexp_extract("href", ENTRY, 1).alias("slug"))
    return slug.where((F.col("slug") != "") & ~F.col("slug").isin(*PLACEHOLDERS)).distinct()


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are, else as GB18030 with replacement characters."""

    other = rowwise(lambda b: None if b is None else b.decode("gb18030", "replace"), "string")
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "utf-8")).otherwise(other(content))


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page."""

    def resolve(at: str | None, link: str | None) -> str | None:
        from urllib.parse import urljoin

        return None if link is None else urljoin(at or "", link)

    return rowwise(resolve, "string")(base, href)


def mhtml_part(value: Column) -> Column:
    """The first HTML part of an MHTML file (bytes), or null."""

    def part(held: bytes | None) -> str | None:
        from email import message_from_bytes, policy

        if not held:
            return None
        message = message_from_bytes(held, policy=policy.default)
        return next((m.get_content() for m in message.walk() if m.get_content_type() == "text/html"), None)

    return rowwise(part, "string")(value)
