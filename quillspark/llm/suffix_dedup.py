"""Removal of repeated byte strings: column-wise construction of collection BWTs and common prefixes over candidates.

Every string of LENGTH bytes holds a chosen gram (the least hash of its grams, the rightmost of equals), at the same
place wherever the string occurs. So two equal strings meet under an equal gram. Grams found once are dropped;
occurrences with equal surroundings are collapsed to the earliest, all others being repeats over their whole
surroundings; the rest is dealt by what a family of neighbouring strings has in common, and each dealt collection
gets its Burrows-Wheeler transform and longest common prefixes, one symbol of each of its texts a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspark.llm.common import discard, narrowed, stored

#: Bytes of a string, of a gram, and strings of a family.
LENGTH, GRAM, FAMILY = 100, 48, 18
#: Texts of a collection, about; surroundings that a family's key may gather before it is split into single strings.
COLLECTION, HOT = 1024, 2000
#: Bytes whose grams are hashed at once; longer texts go in overlapping parts.
BLOCK = 1 << 18


def _order(points: np.ndarray, span: int) -> np.ndarray:
    """32-bit hashes of all runs of `span` bytes, by doubling: runs of the powers of two in span are put together."""
    piece, power, width, total, length = _BYTES[points], np.uint32(0x9E3779B1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if span & width:
                n = len(points) - length - width + 1
                total = piece if total is None else total[:n] * power + piece[length : length + n]
                length += width
            if 2 * width > span:
                break
            piece = piece[:-width] * power + piece[width:]
            power, width = power * power, 2 * width
        h = total ^ (total >> np.uint32(15))
        return h * np.uint32(0x85EBCA6B)


_BYTES = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts (text, place, bytes) of texts long enough, gathered into blocks; parts of one text overlap by LENGTH - 1."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
            part = raw[at : at + BLOCK + LENGTH - 1]
            if size and size + len(part) > BLOCK:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen grams: text numbers, places, and for each the first start and number of strings that chose it.

    Neighbouring strings choose the same gram, so the strings of a text fall into runs, one for each row.
    """
    window = LENGTH - GRAM + 1
    out = []
    for parts in _blocks(texts):
        points = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        h = _order(points, GRAM)
        keys = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        span = 1
        while 2 * span <= window:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        keys = np.minimum(keys[: len(keys) - (window - span)], keys[window - span :])
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        within = np.repeat(np.arange(len(parts)), sizes)[: len(keys)]
        kept = np.flatnonzero(np.arange(len(keys)) + LENGTH <= ends[within])
        at = (np.uint64(0xFFFFFFFF) - (keys[kept] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        part = within[kept]
        heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
        at, start, part = at[heads], kept[heads], part[heads]
        shift = np.array([p for _, p, _ in parts])[part] - (ends - sizes)[part]
        out.append((np.array([i for i, _, _ in parts])[part], at + shift, start + shift, np.diff(np.r_[heads, len(kept)])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _mapped(df: DataFrame, function, fields: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out = function(batch.slice(at, 2000))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, fields)


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("raw").to_pylist()


def _anchored(docs: DataFrame, surroundings: bool) -> DataFrame:
    """Rows (h) of chosen grams; with surroundings also c, a hash of all bytes of the run, and doc, tag, pos, low, many."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = _raw(batch)
        owner, place, low, many = anchors(texts)
        own, at = owner.tolist(), place.tolist()
        hash64 = xxhash.xxh3_64_intdigest
        out = {"h": _signed([hash64(texts[i][p : p + GRAM]) for i, p in zip(own, at, strict=True)])}
        if not surroundings:
            return out
        out["c"] = _signed([hash64(texts[i][a : a + n + LENGTH - 1], p - a) for i, p, a, n in zip(own, at, low.tolist(), many.tolist(), strict=True)])
        where = pa.array(owner)
        return out | {"doc": batch.column("doc").take(where), "tag": batch.column("tag").take(where), "pos": place.astype(np.int32), "low": low.astype(np.int32), "many": many.astype(np.int8)}

    return _mapped(docs, run, "h long" + ", c long, doc long, tag long, pos int, low int, many byte" * surroundings)


def _families(docs: DataFrame) -> DataFrame:
    """For each run (pos, low, many) in the list `at`: rows (key, cx, doc, tag, start, size) of its families of strings.

    A family is up to FAMILY neighbouring starts of a run, on a grid that the gram sets; its key hashes the bytes that
    all strings of its grid cell share, cx all bytes it reaches.
    """
    names = ("key", "cx", "doc", "tag", "start", "size")

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for raw, doc, tag, runs in zip(*(batch.column(c).to_pylist() for c in ("raw", "doc", "tag", "at")), strict=True):
            for x in runs:
                p, low, end = x["pos"], x["low"], x["low"] + x["many"]
                cell = p - LENGTH + GRAM
                cell += (low - cell) // FAMILY * FAMILY
                while cell < end:
                    first, last = max(cell, low), min(cell + FAMILY, end) - 1
                    key = xxhash.xxh3_64_intdigest(raw[cell + FAMILY - 1 : cell + LENGTH], p - cell)
                    rows.append((key, xxhash.xxh3_64_intdigest(raw[first : last + LENGTH], first - cell), doc, tag, first, last - first + LENGTH))
                    cell += FAMILY
        out = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}
        return out | {"key": _signed(out["key"]), "cx": _signed(out["cx"])}

    return _mapped(docs, run, "key long, cx long, doc long, tag long, start int, size int")


def _singles(docs: DataFrame) -> DataFrame:
    """For each (start, size) in the list `at`: rows (key, cx, doc, tag, start) of its single strings."""
    names = ("key", "cx", "doc", "tag", "start")

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for raw, doc, tag, spans in zip(*(batch.column(c).to_pylist() for c in ("raw", "doc", "tag", "at")), strict=True):
            for s in sorted({s for x in spans for s in range(x["start"], x["start"] + x["size"] - LENGTH + 1)}):
                string = raw[s : s + LENGTH]
                rows.append((xxhash.xxh3_64_intdigest(string), xxhash.xxh64_intdigest(string), doc, tag, s))
        out = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}
        return out | {"key": _signed(out["key"]), "cx": _signed(out["cx"])}

    return _mapped(docs, run, "key long, cx long, doc long, tag long, start int")


def collection_bwt(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: text numbers, suffix lengths, and common prefixes with the one before.

    Column by column from the right, each round prepends one symbol to every text that has one left. The place of a
    new suffix follows from the transform so far (its symbol's rank at the place of the text's last suffix), and its
    common prefix is one more than the least between the two places where that symbol last occurred. End marks
    differ from text to text and share nothing. The transform and its companions of each round are written anew from
    those of the round before, front to back.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    held = np.unique(np.frombuffer(b"".join(texts), np.uint8))
    code = np.zeros(256, np.uint8 if len(held) < 256 else np.uint16)
    code[held] = np.arange(1, len(held) + 1)
    columns = np.zeros((int(sizes.max(initial=0)) + 1, m), code.dtype)
    for i, t in enumerate(texts):
        columns[: len(t), i] = code[np.frombuffer(t, np.uint8)[::-1]]
    bwt, lcp = columns[0].copy(), np.zeros(m, np.uint8 if len(columns) < 256 else np.int32)
    spot = np.arange(m)
    for j in range(1, len(columns)):
        active = np.flatnonzero(sizes >= j)
        n, last = len(bwt), spot[active]
        order, rank, ended = _ranks(bwt)
        chain = order[ended:]
        new = rank[last] - ended
        near = np.zeros(len(chain) + 1, bool)
        near[new] = near[new + 1] = True
        touched = np.flatnonzero(near[:-1])
        before = np.maximum(touched - 1, 0)
        paired = (touched > 0) & (bwt[chain[touched]] == bwt[chain[before]])
        value = np.zeros(len(touched), lcp.dtype)
        if paired.any():
            value[paired] = 1 + _range_least(lcp, chain[before[paired]] + 1, chain[touched[paired]])
        at = m + new
        keep = np.ones(n + len(active), bool)
        keep[at] = False
        grown = [np.empty(n + len(active), x.dtype) for x in (bwt, lcp)]
        grown[0][keep], grown[1][keep] = bwt, lcp
        bwt, lcp = grown
        bwt[at] = columns[j][active]
        lcp[m + touched] = value
        spot[active] = at
    owner, length = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    _, rank, ended = _ranks(bwt)
    at = np.arange(m)
    for j in range(len(columns)):
        here = np.flatnonzero(sizes >= j)
        owner[at[here]], length[at[here]] = here, j
        at[here] = m + rank[at[here]] - ended
    return owner, length, lcp


def _ranks(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in the order of their symbols, each place's rank in it, and how many places hold an end mark."""
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    return order, rank, int(len(bwt) - np.count_nonzero(bwt))


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], both ends included, from minima over doubled spans."""
    span = (high - low + 1).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, table, width = np.empty(len(low), values.dtype), values, 1
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def repeats(texts: list[bytes], doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and offsets of all strings of LENGTH bytes that another text of the collection holds earlier."""
    owner, length, lcp = collection_bwt(texts)
    group = np.cumsum(lcp < LENGTH)
    long = np.flatnonzero(length >= LENGTH)
    owner, group = owner[long], group[long]
    offset = np.array([len(t) for t in texts])[owner] - length[long]
    at = start[owner] + offset
    order = np.lexsort((at, tag[owner], doc[owner], group))
    g, d, t, a = group[order], doc[owner][order], tag[owner][order], at[order]
    head = np.r_[True, g[1:] != g[:-1]]
    first = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    later = (d != d[first]) | (t != t[first]) | (a != a[first])
    return owner[order][later], offset[order][later]


def _collections(dealt: DataFrame) -> DataFrame:
    """Rows (doc, tag, start, size) of repeated strings, from rows (key, doc, tag, start, raw) sorted by key."""
    schema = to_arrow_schema(StructType.fromDDL("doc long, tag long, start int, size int"))

    def settle(rows: list) -> pa.RecordBatch:
        _, doc, tag, start, texts = zip(*rows, strict=True)
        doc, tag, start = (np.array(x, np.int64) for x in (doc, tag, start))
        owner, offset = repeats(list(texts), doc, tag, start)
        at = start[owner] + offset
        order = np.lexsort((at, tag[owner], doc[owner]))
        d, t, a = doc[owner][order], tag[owner][order], at[order]
        if not len(a):
            return pa.RecordBatch.from_pylist([], schema=schema)
        head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] > a[:-1] + 1)])
        last = np.r_[head[1:] - 1, len(a) - 1]
        return pa.RecordBatch.from_arrays([pa.array(d[head]), pa.array(t[head]), pa.array(a[head].astype(np.int32)), pa.array((a[last] - a[head] + LENGTH).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "tag", "start", "raw")), strict=True):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return dealt.mapInArrow(run, "doc long, tag long, start int, size int")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) for each row of df.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a smaller key, or in the same row before
    it. Null keys come after all others, rows that share a key in the order of a hash of their texts; rows alike in
    key and text are one document, and each comes back. Null texts are empty, texts under LENGTH bytes stay whole.
    Other columns play no part; an empty table gives no rows.
    """
    rows = narrowed(df, doc_id=key, text=text).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    shared = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    rows = rows.withColumn("tag", F.xxhash64("raw") if shared else F.lit(0).cast("long"))
    docs = rows.where(F.octet_length("raw") >= LENGTH).select("doc", "tag", "raw")
    if shared:
        docs = docs.groupBy("doc", "tag").agg(F.first("raw").alias("raw"))
    # Stored, so that both sides of the join below are plain shuffles and a gram of very many places can be split.
    twice = stored(_anchored(docs, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    found = stored(_anchored(docs, True).join(twice.hint("shuffle_hash"), "h", "left_semi"), "anchors")
    discard(twice)
    classes = stored(found.groupBy("h", "c").agg(F.min(F.struct("doc", "tag", "low", "pos", "many")).alias("first")).select("h", "first.*"), "classes")
    several = classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    open_ = classes.join(several, "h").groupBy("doc", "tag").agg(F.collect_list(F.struct("pos", "low", "many")).alias("at"))
    families = stored(_families(docs.join(open_.hint("shuffle_hash"), ["doc", "tag"])), "families")
    kinds = stored(families.groupBy("key", "cx").agg(F.min(F.struct("doc", "tag", "start", "size")).alias("first")).select("key", "first.*"), "kinds")
    mixed = kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rest = stored(kinds.join(mixed, "key"), "mixed")
    cut = docs.join(rest.where(F.col("n") <= HOT).groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "start", "size")).alias("at")).hint("shuffle_hash"), ["doc", "tag"])
    dealt = cut.select("doc", "tag", "raw", F.explode("at").alias("x")).select("x.key", "doc", "tag", "x.start", F.substring(F.col("raw"), F.col("x.start") + 1, F.col("x.size")).alias("raw"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = stored(_collections(dealt.repartition(tasks, "key").sortWithinPartitions("key", "doc", "tag", "start")), "matched")
    hot = rest.where(F.col("n") > HOT)

    def marks(kind: int, frame: DataFrame, place: str) -> DataFrame:
        return frame.select("doc", "tag", (F.expr(place).cast("long") * 8 + kind).alias("mark"))

    run, family = "bigint(low) * 128 + many", f"bigint(start) * 128 + size - {LENGTH - 1}"
    union = marks(0, found, run).unionByName(marks(1, classes, run)).unionByName(marks(2, families, family)).unionByName(marks(3, kinds, family))
    union = union.unionByName(marks(4, matched, "start")).unionByName(marks(5, matched, "start + size"))
    if hot.limit(1).count():
        split = stored(_singles(docs.join(hot.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("at")).hint("shuffle_hash"), ["doc", "tag"])), "singles")
        heads = split.groupBy("key", "cx").agg(F.min(F.struct("doc", "tag", "start")).alias("first")).select("first.*")
        union = union.unionByName(marks(6, split, "start")).unionByName(marks(7, heads, "start"))
    marked = union.groupBy("doc", "tag").agg(F.collect_list("mark").alias("marks"))
    out = rows.join(marked.hint("shuffle_hash"), ["doc", "tag"], "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _kept(out.select("doc_id", "raw", "marks"), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _kept(df: DataFrame, fields: str) -> DataFrame:
    """Apply the marks, place * 8 + kind.

    Kinds 0, 2 and 6 are runs, families (first start * 128 + number of strings) and single strings, which go unless
    they are the first of their kind (1, 3, 7); 4 and 5 are the starts and ends of what the collections found.
    """
    import hashlib

    def covered(n: int, marks: np.ndarray) -> np.ndarray:
        kind, place = marks & 7, marks >> 3
        steps = np.zeros(n + 1, np.int64)
        later = {every: np.setdiff1d(place[kind == every], place[kind == every + 1]) for every in (0, 2, 6)}
        for low, many in ((later[0] >> 7, later[0] & 127), (later[2] >> 7, later[2] & 127), (later[6], 1)):
            np.add.at(steps, low, 1)
            np.add.at(steps, low + many - 1 + LENGTH, -1)
        np.add.at(steps, place[kind == 4], 1)
        np.add.at(steps, place[kind == 5], -1)
        return np.cumsum(steps[:-1]) > 0

    def run(batch: pa.RecordBatch) -> dict:
        marks = batch.column("marks")
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, raw in enumerate(_raw(batch)):
            gone, spans, kept = 0, 0, raw
            if marks[i].is_valid:
                hit = covered(len(raw), marks[i].values.to_numpy())
                gone = int(hit.sum())
                spans = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~hit].tobytes() if gone else raw
            for name, value in zip(out, (len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[name].append(value)
        return out | {"doc_id": batch.column("doc_id")}

    return _mapped(df, run, fields)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
