import random
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import crawl, state, usage, validation


def test_state_over_restarts(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    table = lambda rows: spark.createDataFrame(rows, "novel_id string, pos long, title string, paragraphs array<string>, source_hash string")
    row = lambda n, p, t: (n, p, t, [t, "x"], None)
    read = lambda: sorted((r.novel_id or "", r.pos, r.title) for r in state.results(spark, folder).load().collect())
    assert read() == []
    state.results(spark, folder).upsert(table([row("a", 0, "one"), row("a", 1, "two"), row(None, 0, "none")]))
    assert read() == [("", 0, "none"), ("a", 0, "one"), ("a", 1, "two")]
    held = state.results(spark, folder)
    held.upsert(table([row("a", 1, "new"), row("b", 0, "b"), row("b", 0, "a")]))
    held.delete(table([row("a", 0, ""), row(None, 0, ""), row("gone", 9, "")]))
    assert read() == [("a", 1, "new"), ("b", 0, "b")]
    # a version that was not committed, and one whose file is broken
    (Path(tmp_path) / "s" / "00000004-set").mkdir()
    assert read() == [("a", 1, "new"), ("b", 0, "b")]
    held.upsert(table([row("c", 0, "c")]).coalesce(1))
    part = next((Path(tmp_path) / "s" / "00000005-set").glob("part-*.parquet"))
    saved = part.read_bytes()
    for crc in part.parent.glob(".part-*.crc"):
        crc.unlink()
    part.write_bytes(b"broken")
    assert read() == [("a", 1, "new"), ("b", 0, "b")]
    part.write_bytes(saved)
    held.compact()
    assert read() == [("a", 1, "new"), ("b", 0, "b"), ("c", 0, "c")] and len(held.versions()) == 1
    held.clear()
    assert read() == [] and [p.name for p in sorted((Path(tmp_path) / "s").iterdir())] == ["00000007-whole"]
    held.upsert(table([row("d", 0, "d")]))
    assert read() == [("d", 0, "d")]
    shutil.rmtree(tmp_path / "s")
    assert read() == []


def test_state_compacts_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "MOST", 3)
    held = state.progress(spark, f"file://{tmp_path}/p")
    for i in range(9):
        held.upsert(spark.createDataFrame([("b", f"http://x/{i}", "t", i), (f"b{i}", "u", None, None)], held.schema))
    assert len(held.versions()) <= 3 and held.load().count() == 10
    assert held.load().where("book_id = 'b'").first().last_url == "http://x/8"


def brute_locate(pages, wanted, saved):
    """A walk over single pages: pages {page: number or None}."""
    page = wanted + (saved[0] - saved[1] if saved else 0)
    seen, after = [], None
    while len(seen) < 12 and page >= 1 and page not in seen:
        seen.append(page)
        number = pages.get(page)
        if page in pages and number == wanted:
            return page, len(seen)
        if number is not None and number > wanted and (after is None or number < after[1]):
            after = (page, number)
        page += (-1 if after else 1) if page not in pages else 1 if number is None else wanted - number
    return (after[0] if after else wanted), len(seen)


def test_pages_are_located_by_probing(spark):
    books = {
        "shifted": ({p: p - 12 for p in range(13, 900)}, [(813, (700, 688)), (813, None), (5, None)]),
        "notices": ({p: None if p % 5 == 0 else p - p // 5 for p in range(1, 300)}, [(100, None), (100, (50, None)), (200, (101, 81))]),
        "deleted": ({p: p for p in range(1, 100) if p not in (40, 41, 42)}, [(41, None), (99, None), (120, None)]),
        "empty": ({}, [(3, None)]), "loop": ({1: 5, 5: 1}, [(3, None), (2, None)]), "far": ({p: 2 * p for p in range(1, 500)}, [(300, None), (301, None)]),
    }
    rng = random.Random(10)
    for i in range(20):
        pages = {p: rng.choice([None, p, p - rng.randint(0, 9), p + 3]) for p in range(1, 60) if rng.random() < 0.9}
        books[f"r{i}"] = (pages, [(w, rng.choice([None, (p, pages[p])]) if (p := rng.choice(list(pages))) and pages[p] is not None else None) for w in rng.sample(range(1, 60), 4)])
    pages = spark.createDataFrame([(b, p, n) for b, (there, _) in books.items() for p, n in there.items()], "book_id string, page long, number long")
    rows = [(b, w, *(s if s and s[1] is not None else (None, None))) for b, (_, asked) in books.items() for w, s in asked]
    wanted = spark.createDataFrame(rows, "book_id string, wanted long, saved_page long, saved_number long")
    got = sorted((r.book_id, r.wanted, r.page, r.probes) for r in crawl.locate_page(pages, wanted).collect())
    assert got == sorted((b, w, *brute_locate(books[b][0], w, (p, n) if p is not None else None)) for b, w, p, n in rows)


def test_attempts_make_sessions(spark):
    at = lambda s: f"2026-01-05 00:00:{s:02d}" if s < 60 else f"2026-01-05 00:{s // 60:02d}:{s % 60:02d}"
    log = [
        ("a", at(0), 1, 500, None), ("a", at(1), 2, 429, None), ("a", at(3), 3, 200, "text"),  # waits of 1 and 2 seconds
        ("a", at(10), 1, 200, " "), ("a", at(20), 1, 200, "text"),  # an empty answer whose next attempt never came
        ("b", at(0), 1, 402, None), ("b", at(30), 5, 503, None), ("b", at(45), 6, 503, None), ("b", at(76), 7, 503, None),  # 16 and 30 seconds, 30 at most
    ]
    df = spark.createDataFrame(log, "call string, ts string, attempt long, code int, body string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.call, r.attempts, r.waited, r.outcome) for r in validation.attempt_sessions(df, ["call"]).collect())
    assert got == [("a", 1, 0, "ok"), ("a", 1, 1, "failed"), ("a", 3, 3, "ok"), ("b", 1, 0, "stop"), ("b", 3, 76, "failed")]


def test_next_offpeak_on_holidays(spark):
    times = ["2026-01-05 01:30:00", "2026-01-06 01:30:00", "2026-01-05 09:59:00", "2026-01-05 10:00:00", "2026-01-04 02:00:00"]
    events = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    days = spark.createDataFrame([("2026-01-06",)], "day string").select(F.col("day").cast("date").alias("day"))
    got = {str(r.ts): str(r.starts) for r in usage.next_offpeak(events, days).collect()}
    assert got == {times[0]: "2026-01-05 04:00:00", times[1]: times[1], times[2]: "2026-01-05 10:00:00", times[3]: times[3], times[4]: times[4]}
