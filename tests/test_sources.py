import pytest
from pyspark.sql import functions as F

from quillspark.sources import dictionaries, pages, responses
from quillspark.streaming import chapters as stream

BODY = "<p>A first paragraph of the chapter.</p><p>And a second one.</p>"


@pytest.mark.parametrize(("html", "status", "title", "paragraphs"), [
    (f"<h1>Chapter 1 (1/2)</h1><article><h1>x</h1>{BODY}<script>p</p></script></article>", "ok", "Chapter 1", ["A first paragraph of the chapter.", "And a second one."]),
    ("<div class='title'>T</div><div id=content>T<br>line one of it all<br>loadAdv(1);<br>line two &amp; more</div>", "ok", "T", ["line one of it all", "line two & more"]),
    ("<h1>a</h1><div class=content><p>one line here to read<br>and another</p></div>", "ok", "a", ["one line here to read", "and another"]),
    ("<title>checking your browser</title>", "challenge", "checking your browser", None),
    ("<h1>a</h1><div class=content><p>short</p></div>", "too_short", "a", None), ("<h1>a</h1>", "no_content", "a", None), (None, "no_content", "", None),
])
def test_chapter_pages(spark, html, status, title, paragraphs):
    row = pages.chapters_of_pages(spark.createDataFrame([(1, "http://www.uukanshu.cc/book/1/2.html", html)], "page_id long, url string, html string")).first()
    assert (row.site, row.status, row.title, row.paragraphs) == ("uukanshu", status, title, paragraphs)


def test_catalogue_and_ids(spark):
    html = "<a href='/book/11/1.html'>One</a><a href='/book/11/2.html'>Two</a><a href='/book/11/1.html?x'>Again</a><a href='/book/12/9.html'>Other</a><a href='/book/11/3.html'> </a>"
    df = spark.createDataFrame([(1, "https://uukanshu.cc/book/11/", html)], "page_id long, url string, html string")
    assert [(r.ord, r.url, r.title) for r in pages.catalogue(df).orderBy("ord").collect()] == [(0, "https://uukanshu.cc/book/11/1.html", "One"), (1, "https://uukanshu.cc/book/11/2.html", "Two")]
    assert df.select(pages.absolute(F.col("url"), F.lit("../x?y")).alias("o")).first().o == "https://uukanshu.cc/book/x?y"


def test_book_metadata(spark):
    html = "<meta property='og:novel:author' content='作者：An'><meta property='og:novel:category' content='Tale'><script type='application/ld+json'>{\"@type\": \"Book\", \"name\": \"N\", \"datePublished\": \"2020-02-30\"}</script><title>t</title>"
    row = pages.book_metadata(spark.createDataFrame([(1, "http://a/b", html)], "page_id long, url string, html string")).first()
    assert tuple(row)[1:] == ("N", "An", "Tale", "")


def test_paged_chapters(spark):
    rows = [("b", "1", 1, 2, "ok", ["a"]), ("b", "1", 2, 2, "ok", ["b"]), ("b", "2", 1, 2, "ok", ["c"]), ("b", "3", 1, 1, "retry", [])]
    out = pages.join_chapter_pages(spark.createDataFrame(rows, "book string, chapter string, page int, last int, status string, paragraphs array<string>"))
    assert {r.chapter: (r.status, r.paragraphs) for r in out.collect()} == {"1": ("ok", ["a", "b"]), "2": ("retry", None), "3": ("retry", None)}


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("中文".encode("gb18030")),)], "b binary")
    assert [r.o for r in df.select(pages.decoded(F.col("b")).alias("o")).collect()] == ["é", "中文"]


def test_dictionaries(spark):
    lines = spark.createDataFrame([(0, "# x"), (1, "國 国 [guo2] /nước/quốc gia/"), (2, "好 好 [hao3] /ok/tốt lắm/"), (3, "國 国 [guo] /đất nước/"), (4, "junk")], "n int, value string")
    assert {tuple(r) for r in dictionaries.cvdict_text(lines).collect()} == {("國", "đất nước"), ("好", "tốt lắm")}
    js = spark.createDataFrame([('{"国": {"trad": "國", "definition": "nước; quốc"}, "好": {"trad": "好", "definition": ""}}',)], "value string")
    assert [tuple(r) for r in dictionaries.cvdict_json(js).collect()] == [("國", "nước")]
    csv = spark.createDataFrame([("行", "['hành', 'hàng']"), ("行", "['hạnh', 'HÀNG']")], "char string, hanviet string")
    assert dictionaries.readings_csv(csv).first().readings == ["hàng", "hành", "hạnh"]
    kv = spark.createDataFrame([("# a=b",), ("甲=một/hai",), ("乙 = x=y",), ("z",)], "value string")
    assert {tuple(r) for r in dictionaries.phrases(kv).collect()} == {("甲", "một"), ("乙", "x=y")}
    hsk = spark.createDataFrame([('[{"hanzi": "甲", "sinoViet": "giáp; a"}, {"character": "乙", "hanviet": "ất"}]',)], "value string")
    assert {tuple(r) for r in dictionaries.hsk_json(hsk).collect()} == {("甲", "giáp"), ("甲", "a"), ("乙", "ất")}
    glossary = spark.createDataFrame([(0, "甲: A"), (1, " "), (2, "甲: B: C")], "n int, value string")
    assert [tuple(r) for r in dictionaries.glossary_lines(glossary).collect()] == [("甲", "B: C")]
    a, b, c = (spark.createDataFrame(x, "word string, meaning string") for x in ([("x", "1"), ("y", "1")], [("x", "2")], [("x", "0"), ("z", "0")]))
    assert {tuple(r)[:2] for r in dictionaries.priority_union([a, b], c).collect()} == {("x", "2"), ("y", "1"), ("z", "0")}


def test_replies(spark):
    bodies = ['{"title": "T", "paragraphs": ["a", "b"], "idioms": {"k": "v"}}', '{"title": "T\\"q", "paragraphs": ["a\\nb", "c"], "new_terms": {"甲": "A"}, broken', "nothing", None]
    out = [r.o for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(responses.reply(F.col("b")).alias("o")).collect()]
    assert out[0].paragraphs == ["a", "b"] and out[0].idioms == {"k": "v"}
    assert (out[1].title, out[1].paragraphs, out[1].new_terms, out[1].idioms) == ('T"q', ["a\nb", "c"], {"甲": "A"}, {})
    assert out[2:] == [None, None]


def test_event_streams(spark):
    chunk = lambda t: 'data: {"choices": [{"delta": {"content": "%s"}}]}' % t
    lines = [chunk("He"), "", "data: broken", chunk("llo"), 'data: {"choices": [], "usage": {"prompt_tokens": 5}}', "data: [DONE]", chunk("noise")]
    row = responses.event_streams(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "response_id string, pos int, line string")).first()
    assert (row.body, row.usage.prompt_tokens) == ("Hello", 5)


def test_stream_appends_in_order_once(spark, tmp_path):
    schema = "novel_id string, pos int, body string"
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run(limit=None, bad=()):
        work = lambda df: df.withColumn("ok", ~F.col("body").isin(*bad) if bad else F.lit(True))
        stream.append_in_order(stream.chapter_source(spark, folder, schema), out, state, work, limit).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("novel_id", "pos", "body").collect())

    put([("a", 1, "a1"), ("a", 3, "a3"), ("b", 0, "b0")])
    assert run() == [("b", 0, "b0")]
    put([("a", 0, "a0"), ("b", 0, "again"), ("b", 1, "b1")])
    assert run(bad=["b1"]) == [("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0")]
    put([("a", 2, "a2"), ("b", 2, "b2")])
    assert run() == [("a", i, f"a{i}") for i in range(4)] + [("b", i, f"b{i}") for i in range(3)]


def test_term_usage_state(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([("n", 1, "x"), ("n", 2, "x"), ("n", 3, "y")], "novel_id string, pos long, zh string").write.parquet(folder)
    query = stream.term_usage(stream.chapter_source(spark, folder, "novel_id string, pos long, zh string")).writeStream.outputMode("update").format("memory").queryName("uses").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.zh, r.last_seen, r["count"]) for r in spark.table("uses").collect()} >= {("x", 2, 2), ("y", 3, 1)}


def test_pages_nested_deeply_and_workers_without_the_package(spark, tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    html = "<div class=content>" + "<div>" * 5000 + "<p>" + "words of a chapter " * 3 + "</p><nav>menu</nav>"
    row = pages.chapters_of_pages(spark.createDataFrame([(1, "https://biquge.tw/book/1/2.html", html)], "page_id long, url string, html string")).first()
    assert (row.status, row.paragraphs) == ("ok", [("words of a chapter " * 3).strip()])
    (tmp_path / "f").write_bytes(cloudpickle.dumps(pages._page))
    code = "import pickle; print(pickle.load(open('f', 'rb'))('<h1>T</h1>', ['h1'], ['article'])['title'])"
    assert subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True).stdout.strip() == "T"


def test_dictionary_built_from_all_sources(spark):
    table = lambda rows, fields: spark.createDataFrame(rows, fields)
    out = dictionaries.built({
        "cvdict": table([(1, "甲 甲 [a] /one/"), (2, "乙 乙 [b] /two/")], "n long, value string"),
        "phrases": table([(1, "乙=old"), (2, "乙=new/x"), (3, "# c=d")], "n long, value string"),
        "seeds": table([("甲", "seed"), ("丙", " ")], "word string, meaning string"),
        "glossary": table([("甲", "mine"), ("丁", "kept")], "word string, meaning string"),
        "readings": table([("中=trúng",), ("中=trung",), ("中=Trung",)], "value string"),
    })
    assert {tuple(r) for r in out["words"].collect()} == {("甲", "seed", 6), ("乙", "new", 3), ("丁", "kept", 0)}
    assert [tuple(r) for r in out["chars"].collect()] == [("中", ["trung", "trúng"])]


def test_dictionary_pages_and_inspection(spark):
    html = [
        (1, '<p class="lead">first</p><li>Đang xem mục từ: can dự - 干預» x'),
        (2, '<script type="application/ld+json">{"name": "Đang xem mục từ: can - 干預"}</script><p class="lead big">second <b>one</b> (Từ điển A)</p>'),
        (3, '<p class="lead">no name</p>'), (4, "Đang xem mục từ: a - b"), (5, None), (6, ""),
    ]
    saved = spark.createDataFrame(html, "page_id long, html string")
    assert [tuple(r) for r in pages.dictionary_entries(saved).collect()] == [("干預", "second one")]
    assert pages.entry_slugs(saved).count() == 0
    lines = spark.createDataFrame([(3, "c"), (1, "#"), (2, "b"), (4, " "), (5, None)], "n long, value string")
    assert [tuple(r) for r in dictionaries.inspected({"a": lines, "b": lines.where("false")}).collect()] == [("a", 2, ["b", "c"]), ("b", 0, [])]


def test_catalogue_parses_each_page_once(spark, tmp_path):
    from quillspark.sources import pages as P

    @F.udf("string")
    def noted(url):
        with open(f"{tmp_path}/seen", "a") as f:
            f.write(f"{url}\n")
        return '<div id="catalog"><ul><li data-num="2"><a href="/txt/7/2">b</a><li data-num="1"><a href="/txt/7/1">a</a></ul></div>'

    rows = spark.range(3).select(F.col("id").alias("page_id"), F.lit("https://www.69shuba.com/book/7.htm").alias("url")).withColumn("html", noted("url"))
    out = sorted(tuple(r) for r in P.catalogue(rows).select("page_id", "ord", "title").collect())
    assert out == [(i, n, t) for i in range(3) for n, t in ((0, "a"), (1, "b"))]
    assert len(open(f"{tmp_path}/seen").readlines()) == 3


def test_streamed_terms_without_calls_for_each_use():
    import random

    from quillspark.streaming import evolving

    rng = random.Random(3)
    word = lambda least, most: "".join(rng.choice("ab年𠀀") for _ in range(rng.randint(least, most)))
    for _ in range(200):
        names = list({word(1, 9) for _ in range(20)})
        found, text = evolving._Terms([(zh, f"={zh}", i) for i, zh in enumerate(names)], {}), word(0, 60)
        assert list(found.used(text).items()) == [(zh, f"={zh}") for zh in names if zh in text]
    kept, plain = evolving._Terms([], {"x": (1, 1), "y": (3, 2)}), {"x": (1, 1), "y": (3, 2)}
    for at in range(4, 900):
        for zh in {rng.choice("abcdefgxy") + str(at // 300 * rng.randint(0, 3)) for _ in range(rng.randint(0, 1) if at % 300 < 150 else 0)}:
            kept.use(zh, at)
            plain[zh] = (at, plain.get(zh, (0, 0))[1] + 1)
        if at % evolving.PURGE == 0:
            idle = [zh for zh, (last, count) in plain.items() if count == 1 and at - last > evolving.IDLE]
            assert kept.purge(at) == len(idle)
            plain = {zh: m for zh, m in plain.items() if zh not in idle}
            assert kept.meta == plain


def test_streamed_rows_beyond_memory_wait_in_state(monkeypatch):
    import json
    from types import SimpleNamespace

    import pandas as pd

    from quillspark.streaming import evolving

    class Map(dict):
        calls = 0
        keys = lambda self: list(dict.keys(self))
        iterator = lambda self: iter(list(self.items()))
        containsKey = dict.__contains__

        def getValue(self, k):
            Map.calls += 1
            return self[k]

        def updateValue(self, k, v):
            Map.calls += 1
            self[k] = v

        removeKey = dict.__delitem__

    place = SimpleNamespace(at=None)
    value = SimpleNamespace(exists=lambda: place.at is not None, get=lambda: place.at, update=lambda v: setattr(place, "at", v))
    names = {k: Map() for k in ("waiting", "terms", "meta")}
    texts = [f"alpha beta gamma{i % 7} delta{i}" for i in range(300)]
    rows = [(i, 0, json.dumps({"title": "", "paragraphs": [t]})) for i, t in enumerate(texts)]
    rows += [(i, 1, json.dumps({"title": "", "paragraphs": ["X"], "new_terms": {f"gamma{i % 7}": "G"}})) for i in range(300)]

    def run(held, parts):
        monkeypatch.setattr(evolving, "HELD", held)
        place.at = None
        for m in names.values():
            m.clear()
        novel, out = evolving._Novel(), []
        novel.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda n, *a: names[n]))
        for part in parts:
            frame = pd.DataFrame(part, columns=["pos", "attempt", "body"])
            out += [r for f in novel.handleInputRows(("n",), iter([frame]), None) for r in f.itertuples(index=False, name=None)]
        assert not names["waiting"]
        return out

    Map.calls = 0
    whole = run(1 << 20, [rows])
    assert len(whole) == 300 and Map.calls < 50
    assert [r[1] for r in whole] == list(range(300)) and json.loads(whole[8][5]) == {"gamma1": "G"}
    assert run(500, [rows]) == run(500, [rows[::2], rows[1::2], rows[:9]]) == run(1 << 20, [rows[::-1][:200], rows]) == whole


def test_streamed_events_wait_in_packs():
    """Half of a novel's events take a few compressed entries of state, and all are written when the others come."""
    import json
    from types import SimpleNamespace

    import pandas as pd

    from quillspark.streaming import evolving

    class Map(dict):
        keys = lambda self: list(dict.keys(self))
        iterator = lambda self: iter(list(self.items()))
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    events = [(5, "é𠀀\n"), (3, ""), (5, "copy")]
    assert list(evolving._unpack(evolving._pack(events))) == events
    place = SimpleNamespace(at=None)
    value = SimpleNamespace(exists=lambda: place.at is not None, get=lambda: place.at, update=lambda v: setattr(place, "at", v))
    names = {k: Map() for k in ("waiting", "terms", "meta")}
    lines = lambda i, word: [f"{word} number {i} of {i % 9} and {i % 7} in all of these lines" for _ in range(9)]
    rows = [(i, 0, json.dumps({"title": "", "paragraphs": lines(i, "line")})) for i in range(300)]
    rows += [(i, 1, json.dumps({"title": "", "paragraphs": lines(i, "LINE"), "new_terms": {f"number {i}": "N"}})) for i in range(300)]
    rows += [(-1, 0, "left out"), (5, 9, "left out"), (7, 0, "a copy that comes later")]
    got = []
    for part in (rows[1::2], rows[::2]):
        novel = evolving._Novel()
        novel.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda n, *a: names[n]))
        frame = pd.DataFrame(part, columns=["pos", "attempt", "body"])
        got += [r for f in novel.handleInputRows(("n",), iter([frame[:100], frame[100:]]), None) for r in f.itertuples(index=False, name=None)]
        if not got:
            assert len(names["waiting"]) <= 2 * (300 // evolving.BLOCK + 1)
            assert sum(len(v[0]) for v in names["waiting"].values()) < sum(len(r[2]) for r in part) / 4
    assert [r[1] for r in got] == list(range(300)) and place.at == (300,) and not names["waiting"]
    assert all(json.loads(r[6]) == {f"number {r[1]}": "N"} for r in got)


def test_streamed_texts_are_held_once_on_disk(spark):
    """Events that are committed and the numbered texts are gone, what is written is zstd, and replies are parsed once."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from quillspark.plans import chapter_runs
    from quillspark.streaming import evolving

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    old, settings = set(base.glob("stream-*")), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.maintenanceInterval")}
    assert chapter_runs.streaming_glossary(spark, "/root/testdata/sf0.001").count() > 0
    assert {k: spark.conf.get(k) for k in settings} == settings
    (place,) = set(base.glob("stream-*")) - old
    assert {p.name for p in place.iterdir()} == {"out", "state"}
    assert {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in place.glob("out/*.parquet") if pq.ParquetFile(p).metadata.num_row_groups} == {"ZSTD"}
    replies = spark.createDataFrame([("n", 0, 1, '{"paragraphs": ["X"]}')], "novel_id string, pos long, attempt long, body string")
    out = evolving.reply_events(replies.where("length(body) > 0"), "a-z")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1 and out.count() == 1


def test_wide_rows_are_numbered(spark):
    import random

    from quillspark.functions.tables import numbered_wide

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), f"t{i}") for i in range(400)] + [("c", 1, "alone")]
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(3)
    for size in (4, 1000):
        got = {}
        for r in numbered_wide(df, "g", "k", rows=size).collect():
            got.setdefault(r.g, []).append((r.number, r.k, r.t))
        assert sorted((g or "", t) for g, x in got.items() for _, _, t in x) == sorted((g or "", t) for g, _, t in rows)
        for x in got.values():
            keys = [k for _, k, _ in sorted(x)]
            assert [n for n, _, _ in sorted(x)] == list(range(1, len(x) + 1)) and keys == sorted(keys, key=lambda k: -1 if k is None else k)


def test_stateful_stream_across_runs(spark, tmp_path):
    import json
    import shutil

    from quillspark.streaming import evolving

    folder, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    reply = lambda lines, terms=None: json.dumps({"title": "T", "paragraphs": lines, "new_terms": terms or {}}, ensure_ascii=False)
    chapters = {("a", i): ["甲来了", f"第{i}段乙"] for i in range(5)} | {("b", 0): ["丙"], ("b", 1): ["丙丁"]}
    given = {("a", 0): reply(["Giáp", "x"], {"甲": "Giáp An", "丙": "Bính Bính"}), ("a", 1): reply(["Giáp", "x"], {"甲": "Other Name", "乙": "Ất Ất"}), ("b", 0): reply(["x"], {"丙": "Bính Bính"})}

    def put(events):
        rows = [(n, p, 0, json.dumps({"title": "t", "paragraphs": chapters[n, p]}, ensure_ascii=False)) if k == 0 else (n, p, k, b) for n, p, k, b in events]
        ready = spark.createDataFrame(rows, "novel_id string, pos long, attempt long, body string")
        first, answers = ready.where("attempt = 0"), ready.where("attempt > 0")
        first.unionByName(evolving.reply_events(answers)).coalesce(1).write.mode("append").parquet(folder)

    def run():
        return sorted((r.novel_id, r.pos, r.attempt, json.loads(r.used), json.loads(r.added)) for r in evolving.run(spark, folder, target, state).collect())

    put([("a", 1, 0, None), ("a", 1, 1, given["a", 1]), ("b", 0, 0, None), ("b", 0, 1, reply(["x", "too many"])), ("a", 4, 0, None)])
    assert run() == []
    put([("a", 0, 0, None), ("a", 0, 1, given["a", 0]), ("b", 0, 2, given["b", 0]), ("b", 1, 0, None), ("b", 1, 1, reply(["丙 is left"]))])
    want = [("a", 0, 1, {}, {"甲": "Giáp An"}), ("a", 1, 1, {"甲": "Giáp An"}, {"乙": "Ất Ất"}), ("b", 0, 2, {}, {"丙": "Bính Bính"})]
    assert run() == want
    copies = [("a", 0, 0, None), ("a", 1, 1, reply(["again", "again"]))]
    put([*copies, ("a", 3, 0, None), ("a", 3, 1, reply(["x", "y"])), ("b", 1, 2, '{"paragraphs": ["cut off", "wh')])
    want.append(("b", 1, 2, {"丙": "Bính Bính"}, {}))
    # a run that is killed before its batch is committed leaves a batch to do again
    done = run()
    assert done == sorted(want)
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    shutil.move(newest, tmp_path / "gone")
    (tmp_path / "state" / "commits" / f".{newest.name}.crc").unlink(missing_ok=True)
    assert run() == done
    put([("a", 2, 0, None), ("a", 2, 1, reply(["x", "y"])), ("a", 4, 1, reply(["x", "y"]))])
    both = {"甲": "Giáp An", "乙": "Ất Ất"}
    assert run() == sorted(want + [("a", i, 1, both, {}) for i in (2, 3, 4)])


def test_term_counts_are_purged(spark, tmp_path):
    import json

    from quillspark.streaming import evolving

    rows = []
    for i in range(130):
        rows.append(("n", i, 0, json.dumps({"title": "", "paragraphs": ["甲 once" if i == 0 else "乙"]}, ensure_ascii=False)))
        rows.append(("n", i, 1, json.dumps({"title": "", "paragraphs": ["x"], "new_terms": {"甲": "A"} if i == 0 else {"乙": "B"}}, ensure_ascii=False)))
    spark.createDataFrame(rows, evolving.EVENTS).write.parquet(f"file://{tmp_path}/in")
    out = evolving.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(130)) and [r.pos for r in out if r.purged] == [119]
    assert json.loads(out[1].added) == {"乙": "B"} and all(json.loads(r.used) == {"乙": "B"} for r in out[2:])


def test_replies_cut_at_every_place(spark):
    import json

    lines, terms = ['one "q" [x]', "two\nlines", "th\\ree} ,", ""], {"甲": "A, B", "乙": "C}"}
    for key in ("new_terms", "new_names"):
        body = json.dumps({"title": 'T "1"', "paragraphs": lines, key: terms}, ensure_ascii=False)
        ends = [body.index(json.dumps(x, ensure_ascii=False), body.index("[")) + len(json.dumps(x, ensure_ascii=False)) for x in lines]
        places = [body.index(json.dumps(v, ensure_ascii=False)) + len(json.dumps(v, ensure_ascii=False)) for v in terms.values()]
        cut = spark.createDataFrame([(i, body[:i]) for i in range(len(body) + 1)], "i int, b string")
        for r in cut.select("i", responses.reply(F.col("b")).alias("o")).collect():
            whole = lines[: sum(r.i >= e for e in ends)]
            if not whole:
                assert r.o is None
            else:
                assert (r.o.title, r.o.paragraphs, r.o.new_terms or {}) == ('T "1"', whole, dict(list(terms.items())[: sum(r.i >= p for p in places)]))


def test_replies_with_long_paragraphs(spark):
    long = 'a "word" \\\\ and\\n more ' * 50_000
    body = '{"title": "t", "paragraphs": ["' + long.replace('"', '\\"') + '", "short", "cut'
    out = spark.createDataFrame([(body,)], "b string").select(responses.reply(F.col("b")).alias("o")).first().o
    assert len(out.paragraphs) == 2 and len(out.paragraphs[0]) > 1_000_000 and out.paragraphs[1] == "short"


def test_catalogue_orders_and_starts(spark):
    item = lambda k, n=None: f"<li{'' if n is None else f' data-num={n}'}><span><a href='/txt/5/{k}'>t{k}</a></span></li>"
    html = {
        1: item(9, 3) + item(8, 2) + item(7, 1) + item(9, 0), 2: item(9, 3) + item(8) + item(7, 1), 3: item(9) + item(8, 2) + item(7, 1), 4: item(7, 1) + item(8) + item(9, 3), 5: "",
    }
    listed = pages.catalogue(spark.createDataFrame([(k, "https://69shuba.com/book/5.htm", f"<ul>{h}</ul>") for k, h in html.items()], "page_id long, url string, html string"))
    got = {}
    for r in listed.orderBy("page_id", "ord").collect():
        got.setdefault(r.page_id, []).append(r.title)
    assert got == {1: ["t9", "t7", "t8"], 2: ["t7", "t8", "t9"], 3: ["t9", "t8", "t7"], 4: ["t7", "t8", "t9"]}
    starts = spark.createDataFrame([(2, "https://www.69shuba.com/txt/5/9"), (2, "https://www.69shuba.com/txt/6/9"), (5, "https://69shuba.com/txt/5/9")], "page_id long, start_url string")
    assert sorted((r.page_id, r.ord) for r in pages.start_index(listed, starts).collect()) == [(2, 0), (2, 2), (5, 0)]


def test_metadata_of_catalogues_and_chapters(spark):
    ld = lambda x: f"<script type='application/ld+json'>{x}</script>"
    chapter, book = "https://uukanshu.cc/book/1/2.html", "https://uukanshu.cc/book/1/"
    html = [
        (1, chapter, "<title>T</title><meta property='og:title' content='Chapter 5'><h1>Chapter 5</h1><p>作者：Nobody</p>"),
        (2, book, "<title>T</title><h1>The Book</h1><p>作 者： A. Writer</p>"),
        (3, book, "<meta property='og:title' content='OG'><h1>x</h1><i class='book-author'>作者:B</i>"),
        (4, chapter, ld('[{"@type": "Novel", "name": "N", "author": ["A. Writer"], "datePublished": "2020-01-02T03:04:05Z"}]')),
        (5, chapter, ld('{"@type": "Book", "name": "N", "author": [{"name": "C"}], "datePublished": "2020-01-02 and more"}')),
        (6, book, "Just a moment... <h1>x</h1>"), (7, None, None), (8, book, "<p>Author: " + "x" * 81 + "</p><p>Time: 5</p>"),
    ]
    got = {r.page_id: tuple(r)[1:] for r in pages.book_metadata(spark.createDataFrame(html, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("", "", "", ""), 2: ("The Book", "A. Writer", "", ""), 3: ("OG", "B", "", ""), 4: ("N", "A. Writer", "", "2020-01-02T03:04:05Z"), 5: ("N", "C", "", ""),
        6: ("", "", "", ""), 7: ("", "", "", ""), 8: ("", "", "", ""),
    }


def test_saved_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.html").write_bytes("<!-- saved from url=(0014)http://a/b -->\n<h1>é</h1>".encode())
    (tmp_path / "deep" / "b.html").write_bytes("<h1>中文</h1>".encode("gb18030"))
    (tmp_path / "c.mhtml").write_bytes(b"From: x\r\nSnapshot-Content-Location: http://c/d\r\nContent-Type: multipart/related; boundary=\"z\"\r\n\r\n--z\r\nContent-Type: text/css\r\n\r\np{}\r\n--z\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<h1>=C3=A9</h1>\r\n--z--\r\n")
    (tmp_path / "empty.html").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.url, (r.html or "").strip()) for r in pages.saved_pages(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.html": ("http://a/b", "<!-- saved from url=(0014)http://a/b -->\n<h1>é</h1>"), "b.html": (None, "<h1>中文</h1>"), "c.mhtml": ("http://c/d", "<h1>é</h1>")}


def test_idioms_built(spark):
    rows = [(1, "一二三四", "(Tục ngữ) x"), (2, "壹二三四", "(ca dao) y"), (3, "四四四四", "abc"), (4, "五五五五", "ab"), (5, "六六六六", "thành ngữ x"), (6, "一二三四五六七八", "(thành ngữ) z"), (7, "三三a三", "(thành ngữ)"), (8, "四四四四", "later"), (9, None, "x"), (10, "七七七七", None)]
    glossary = spark.createDataFrame(rows, "n long, word string, meaning string")
    phrases = spark.createDataFrame([("四四四四",), ("四四四四",), ("五五五五",), ("一二三四五六七八",), ("七七七七",)], "word string")
    forms = spark.createDataFrame([("一二三四", "一二三四", "壹二三四"), ("壹二三四", "一二三四", "壹二三四")], "word string, simp string, trad string")
    out = dictionaries.idioms_built(glossary, phrases, forms)
    assert {tuple(r) for r in out["canonical"].collect()} == {("壹二三四", "(Tục ngữ) x", "一二三四", "壹二三四"), ("四四四四", "later", "四四四四", "四四四四")}
    assert {tuple(r) for r in out["keys"].collect()} == {("壹二三四", "(Tục ngữ) x"), ("一二三四", "(Tục ngữ) x"), ("四四四四", "later")}
    none = dictionaries.idioms_built(glossary.limit(0), phrases.limit(0), forms.limit(0))
    assert none["keys"].count() == 0


def test_rowwise(spark):
    """A function over values gives every row in its place, nulls and structs with maps too, in pieces of ROWS rows."""
    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    out = rows.select("id", pages.rowwise(lambda a, b: f"{a} {b}", "string")("id", "s").alias("two"), pages.rowwise(lambda a: {"m": [("k", a)], "n": None}, "struct<m:map<string,string>,n:bigint>")("s").alias("x")).collect()
    assert [(r.id, r.two, r.x.m["k"], r.x.n) for r in out] == [(i, f"{i} {i if i % 3 else None}", str(i) if i % 3 else None, None) for i in range(1000)]


def test_blocks_of_a_dictionary_search_are_small():
    import tracemalloc

    import pyarrow as pa

    from quillspark.operators import dictionary

    trie, column = dictionary.Trie(["term", "a longer term"]), pa.array(["some text with a longer term in it. " * 100] * 2000)
    tracemalloc.start()
    found = 0
    for _, offsets, data in dictionary.blocks(column):
        text, byte, _ = dictionary.found_in(trie, offsets, data)
        found += len(dictionary.characters(data, offsets, text, byte))
    assert found == 400_000 and tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def test_pages_saved_in_few_folders(spark, tmp_path):
    """A file for each row, keys and contents repeated or null, in a folder for each task."""
    rows = spark.createDataFrame([(i // 2 if i else None, f"page {i} é" if i % 7 else None) for i in range(200)], "page_id long, value string").coalesce(2)
    assert pages.save_pages(rows, f"file://{tmp_path}/saved") == 200
    assert len(list((tmp_path / "saved").iterdir())) <= 2
    held = sorted((p.name.split("=")[1], p.read_text()) for p in (tmp_path / "saved").glob("*/*.html"))
    assert held == sorted((f"{r.page_id}.html", (r.value or "") + "\n") for r in rows.collect())
