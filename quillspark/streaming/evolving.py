"""Translation as one stateful stream: chapters and replies wait in state until their turn, and terms pass from chapter to chapter."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions import text as X
from quillspark.operators import terms as T
from quillspark.operators.novel_run import ATTEMPTS
from quillspark.sources import responses

#: Chapters between two purges of the terms' metadata, and chapters that a term used once may lie idle.
PURGE, IDLE = 20, 100
#: Bytes of a batch's packs of a novel that wait in memory at most; first characters by which terms are found, as numbers of so many bits.
HELD, BEGIN, SEEN = 32 << 20, 6, 22
#: Chapters in a row whose events are packed together, and how hard packs are compressed.
BLOCK, LEVEL = 256, 9
#: How Parquet files of a stream are written.
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
EVENTS = "novel_id string, pos long, attempt long, body string"
PACKS = "novel_id string, block long, pack binary"
WRITTEN = "novel_id string, pos long, attempt long, title string, paragraphs string, used string, added string, purged long"
COLUMNS = [c.split()[0] for c in WRITTEN.split(", ")]
#: How often executors look for stores whose run has ended, to take them off their disks.
UNLOAD = "10s"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rocks(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _pack(events: list[tuple[int, str]]) -> bytes:
    """Events (place, body) as one compressed value: its size before, their number, places, lengths and bodies."""
    bodies = [body.encode("utf-8", "surrogatepass") for _, body in events]
    raw = np.array([len(events), *(place for place, _ in events), *map(len, bodies)], np.int64).tobytes() + b"".join(bodies)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpack(pack: bytes) -> Iterator[tuple[int, str]]:
    raw = pa.Codec("zstd").decompress(pack[8:], int.from_bytes(pack[:8], "little"), asbytes=True)
    count = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.int64, 2 * count + 1)
    ends = (head.nbytes + np.cumsum(head[count + 1 :])).tolist()
    for place, start, end in zip(head[1 : count + 1].tolist(), [head.nbytes, *ends], ends, strict=False):
        yield place, raw[start:end].decode("utf-8", "surrogatepass")


def _packed(rows: Iterator[tuple[str | None, int, int, str]]) -> Iterator[tuple[str | None, int, bytes]]:
    """Packs (novel_id, block, pack) of rows of EVENTS; rows that no chapter can use are left out."""
    groups: dict[tuple[str | None, int], list[tuple[int, str]]] = {}
    for novel, pos, attempt, body in rows:
        if pos >= 0 and 0 <= attempt <= ATTEMPTS:
            groups.setdefault((novel, pos // BLOCK), []).append((pos * (ATTEMPTS + 1) + attempt, body))
    for (novel, block), events in groups.items():
        yield novel, block, _pack(events)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in EVENTS.split(", ")]
    kinds = pa.schema([("novel_id", pa.string()), ("block", pa.int64()), ("pack", pa.binary())])
    for batch in batches:
        found = list(_packed(zip(*(batch.column(c).to_pylist() for c in names), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in found], kind.type) for i, kind in enumerate(kinds)], schema=kinds)


def _beginnings(text: str, size: int) -> np.ndarray:
    """A number of SEEN bits for the `size` characters from each place of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    count = max(len(points) - size + 1, 0)
    number = np.zeros(count, np.uint32)
    for i in range(size):
        number *= np.uint32(0x01000193)
        number ^= points[i : i + count]
    number *= np.uint32(0x9E3779B1)
    return number >> np.uint32(32 - SEEN)


class _Terms:
    """A novel's terms in memory while its chapters are written: found by their beginnings, their uses counted, changes noted."""

    def __init__(self, terms: list[tuple[str, str, int]], meta: dict[str, tuple[int, int]]) -> None:
        self.known: dict[str, tuple[str, int]] = {}
        self.begins: dict[int, dict[str, list[str]]] = {}
        self.seen: dict[int, np.ndarray] = {}
        for zh, vi, ord in sorted(terms, key=lambda t: (t[2], t[0], t[1])):
            self.put(zh, vi, ord)
        self.meta = meta
        # Terms used once, the longest idle first: last_seen only grows, so new ones go to the end.
        self.once = dict.fromkeys(sorted((zh for zh, (_, count) in meta.items() if count == 1), key=lambda zh: meta[zh][0]))
        self.added: list[str] = []
        self.changed: set[str] = set()

    def put(self, zh: str, vi: str, ord: int) -> None:
        self.known[zh] = (vi, ord)
        begin = zh[:BEGIN]
        size = len(begin)
        if size not in self.seen:
            self.begins[size], self.seen[size] = {}, np.zeros(1 << SEEN, bool)
        if begin not in self.begins[size]:
            self.begins[size][begin] = []
            self.seen[size][_beginnings(begin, size)] = True
        self.begins[size][begin].append(zh)

    def used(self, text: str) -> dict[str, str]:
        """The terms that occur in a text, in their order: compared only at places where some term's first characters may stand."""
        met = set()
        for size, begins in self.begins.items():
            for i in np.flatnonzero(self.seen[size][_beginnings(text, size)]).tolist():
                for zh in begins.get(text[i : i + size], ()):
                    if text.startswith(zh, i):
                        met.add(zh)
        return {zh: self.known[zh][0] for zh in sorted(met, key=lambda zh: self.known[zh][1])}

    def add(self, zh: str, vi: str, at: int) -> None:
        self.put(zh, vi, len(self.known))
        self.added.append(zh)
        self.use(zh, at, 1)

    def use(self, zh: str, at: int, count: int | None = None) -> None:
        count = count or self.meta.get(zh, (0, 0))[1] + 1
        self.meta[zh] = (at, count)
        self.changed.add(zh)
        self.once.pop(zh, None)
        if count == 1:
            self.once[zh] = None

    def purge(self, at: int) -> int:
        """Drop the counts of terms used once and idle for over IDLE chapters; how many."""
        gone = 0
        while self.once and at - self.meta[zh := next(iter(self.once))][0] > IDLE:
            del self.once[zh], self.meta[zh]
            self.changed.add(zh)
            gone += 1
        return gone


class _Novel(StatefulProcessor):
    """One novel: what is written next, the chapters and replies that wait, the terms so far and their uses.

    Each access to state is a call to the JVM. So what waits does so in packs, each the events of some of BLOCK chapters
    in a row, which are opened when it is their turn: up to HELD bytes in memory, the others in state. Terms and uses
    are read once and their changes put back once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "pos long")
        self.waiting = handle.getMapState("waiting", "block long, number long", "pack binary")
        self.terms = handle.getMapState("terms", "zh string", "vi string, ord long")
        self.meta = handle.getMapState("meta", "zh string", "last_seen long, count long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        """Rows are packs, or events, which are packed here."""
        self.at = self.next.get()[0] if self.next.exists() else 0
        self.there: dict[int, list[int]] = {}
        for block, number in sorted(self.waiting.keys()):
            self.there.setdefault(block, []).append(number)
        self.fresh: dict[int, list[bytes]] = {}
        self.known: _Terms | None = None
        size = 0
        for frame in rows:
            if "pack" in frame:
                packs = zip(frame["block"].tolist(), frame["pack"].tolist(), strict=True)
            else:
                events = zip(frame["pos"].tolist(), frame["attempt"].tolist(), frame["body"].tolist(), strict=True)
                packs = ((block, pack) for _, block, pack in _packed((key[0], *event) for event in events))
            for block, pack in packs:
                if (block + 1) * BLOCK > self.at:
                    self.fresh.setdefault(block, []).append(pack)
                    size += len(pack)
                    if size > HELD:
                        yield from self.ready(key[0])
                        self.stored()
                        size = 0
        yield from self.ready(key[0])
        self.stored()
        self.next.update((self.at,))
        if self.known is not None:
            for zh in self.known.added:
                self.terms.updateValue((zh,), self.known.known[zh])
            for zh in self.known.changed:
                if zh in self.known.meta:
                    self.meta.updateValue((zh,), self.known.meta[zh])
                elif self.meta.containsKey((zh,)):
                    self.meta.removeKey((zh,))
        self.there, self.fresh, self.known = {}, {}, None

    def stored(self) -> None:
        """Put what still waits in memory into state."""
        for block, packs in self.fresh.items():
            numbers = self.there.setdefault(block, [])
            for pack in packs:
                numbers.append(numbers[-1] + 1 if numbers else 0)
                self.waiting.updateValue((block, numbers[-1]), (pack,))
        self.fresh = {}

    def opened(self, block: int) -> dict[int, str]:
        """The events of a block that aren't written yet, by place; of copies the first that came."""
        events: dict[int, str] = {}
        for packs in ((self.waiting.getValue((block, n))[0] for n in self.there.get(block, ())), self.fresh.get(block, ())):
            for pack in packs:
                for place, body in _unpack(bytes(pack)):
                    if place >= self.at * (ATTEMPTS + 1):
                        events.setdefault(place, body)
        return events

    def ready(self, novel: str) -> Iterator[pd.DataFrame]:
        """Write the chapters whose turn it is, some at a time."""
        out, size, going = [], 0, True
        while going:
            block = self.at // BLOCK
            events = self.opened(block)
            while (going := (body := events.get(self.at * (ATTEMPTS + 1))) is not None):
                at, chapter = self.at, json.loads(body)
                attempt, reply = self.passing(at, chapter, events)
                if not (going := reply is not None):
                    break
                if self.known is None:
                    self.known = _Terms([(k[0], v[0], v[1]) for k, v in self.terms.iterator()], {k[0]: (v[0], v[1]) for k, v in self.meta.iterator()})
                out.append(self.written(novel, at, attempt, chapter, reply, self.known))
                size += sum(map(len, out[-1][4:7]))
                for place in range(at * (ATTEMPTS + 1), (at + 1) * (ATTEMPTS + 1)):
                    events.pop(place, None)
                self.at += 1
                if size > HELD // 4:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out, size = [], 0
                if self.at // BLOCK > block:
                    break
            if not events:
                self.fresh.pop(block, None)
                for number in self.there.pop(block, ()):
                    self.waiting.removeKey((block, number))
        yield pd.DataFrame(out, columns=COLUMNS)

    def passing(self, at: int, chapter: dict, events: dict[int, str]) -> tuple[int, dict | None]:
        """The first reply that has as many paragraphs as the chapter."""
        for attempt in range(1, ATTEMPTS + 1):
            body = events.get(at * (ATTEMPTS + 1) + attempt)
            if body is not None:
                reply = json.loads(body)
                if len(reply.get("paragraphs") or []) == len(chapter.get("paragraphs") or []):
                    return attempt, reply
        return 0, None

    def written(self, novel: str, at: int, attempt: int, chapter: dict, reply: dict, terms: _Terms) -> tuple:
        text = "\n".join([chapter.get("title") or "", *(chapter.get("paragraphs") or [])])
        used = terms.used(text)
        added = {zh: vi for zh, vi in (reply.get("new_terms") or {}).items() if zh not in terms.known and zh in text}
        for zh, vi in added.items():
            terms.add(zh, vi, at + 1)
        for zh in used:
            terms.use(zh, at + 1)
        idle = terms.purge(at + 1) if (at + 1) % PURGE == 0 else 0
        show = lambda x: json.dumps(x, ensure_ascii=False)
        return novel, at, attempt, reply.get("title"), show(reply.get("paragraphs") or []), show(used), show(added), idle

    def close(self) -> None:
        pass


def chapter_events(chapters: DataFrame) -> DataFrame:
    """Chapters (novel_id, pos, title, paragraphs) as rows of EVENTS; pos counts from 0."""
    return chapters.select(F.col("novel_id").cast("string").alias("novel_id"), F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("attempt"), F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"))).alias("body"))


def reply_events(replies: DataFrame, script: str = X.CJK) -> DataFrame:
    """Replies (novel_id, pos, attempt, body) as rows of EVENTS: parsed or repaired, without those that leave foreign script.

    Their terms are admitted here, but for their place in the chapter's text.
    """
    keys = [F.col("novel_id").cast("string").alias("novel_id"), F.col("pos").cast("long").alias("pos"), F.col("attempt").cast("long").alias("attempt")]
    # What a filter needs is exploded: moved below, a filter would parse each reply again.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    rows = replies.where(F.col("attempt").between(1, ATTEMPTS)).select(*keys, once(responses.reply(F.col("body")), "r")).where("r IS NOT NULL")
    fit = F.map_filter(F.col("r.new_terms"), lambda zh, vi: T.admitted_term(zh, vi, zh, script))
    full = F.filter("r.paragraphs", lambda p: p.isNotNull() & (X.strip(p) != ""))
    rows = rows.select("novel_id", "pos", "attempt", "r", once(full, "full")).where(~X.has_script(F.array_join("full", "\n"), script))
    return rows.select("novel_id", "pos", "attempt", F.to_json(F.struct(F.col("r.title").alias("title"), F.col("full").alias("paragraphs"), fit.alias("new_terms"))).alias("body"))


def translated(events: DataFrame) -> DataFrame:
    """Rows of WRITTEN from a stream of EVENTS, each chapter once and in order.

    A chapter is written when all before it in its novel are and one of its replies passes; until then it and its
    replies wait in state, whatever order and batch they come in. `used` are the terms of earlier chapters that occur
    in it, `added` those that its reply brings and no earlier one had; a term is never replaced. Uses are counted, and
    every PURGE chapters the counts of terms used once and idle for over IDLE chapters go, the terms themselves never.
    Copies of an event and events of written chapters are left out. Events are packed where they are read, so that they
    are shuffled and wait compressed. What a batch costs depends on its own rows and the
    state of their novels, not on what is written.
    """
    return events.select(*[c.split()[0] for c in EVENTS.split(", ")]).mapInArrow(_packs, PACKS).groupBy("novel_id").transformWithStateInPandas(statefulProcessor=_Novel(), outputStructType=WRITTEN, outputMode="Append", timeMode="None")


def run(spark: SparkSession, folder: str, target: str, checkpoint: str, files: int = 1000, tasks: int | None = None) -> DataFrame:
    """Stream the events of a folder (Parquet, EVENTS) that are new since the checkpoint, and read all that is written.

    The file sink commits each batch once; a run that was stopped goes on from its checkpoint. Events that a run has
    committed are not read again and may be deleted. The first run deals novels into `tasks` tasks for good, or into as
    many as shuffles have: each has a store of its own, with at least 4 MB on disk, and a Python process.
    """
    rocks(spark)
    settings = {"spark.sql.streaming.stateStore.maintenanceInterval": UNLOAD} | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    before = {k: spark.conf.get(k) for k in settings}
    stream = translated(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder))
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", target).options(**ZSTD).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(WRITTEN).parquet(target)
