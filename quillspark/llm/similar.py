"""Near-duplicate groups of whole texts: shingle sets alike in 0.8 or more, pruned by pigeonring filtering over SimHashes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import components, discard, map_texts, narrowed, small, stored
from quillspark.llm.simhash import SEED, mixed

#: 64-bit words of a SimHash; bucket keys of a text and minima of a key.
LONGS, BANDS, ROWS = 4, 24, 6
#: Heads drawn from a bucket in a round of stars (and as many outside its largest component), rounds at most, rows by
#: side of a cell of pairs, and shingles by side.
HEADS, ROUNDS, CELL, HEFT = 2, 6, 1024, 4 << 20
#: Pairs still open for each row of open buckets, below which rounds of stars aren't worth their joins.
FEW = 64


def sketch(text: str, words: int = 5, longs: int = LONGS, bands: int = BANDS, rows: int = ROWS) -> tuple[int, list[int], list[int], np.ndarray]:
    """Of a text's distinct word shingles: an identity, a SimHash, `bands` bucket keys and the shingles as sorted 32-bit hashes.

    The identity is a 64-bit hash of the lower-cased words, so texts that differ in white space or case alone share
    it. Fewer words than a shingle make one shingle of all; no words give an empty set, all keys 0.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    same = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(found), SEED)).astype(np.int64))
    if not found:
        return same, [0] * longs, [0] * bands, np.zeros(0, np.int32)
    of_words = np.array([xxhash.xxh64_intdigest(w, SEED) for w in found], dtype=np.uint64)
    size = min(words, len(found))
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(found) - size + 1, np.uint64)
        for i in range(size):
            hashes = mixed(hashes + of_words[i : i + len(hashes)], 1 + i)
        hashes = np.unique(hashes)
        counts, least = np.zeros((longs, 64), np.int64), np.full(bands * rows, ~np.uint64(0))
        factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64), words) | np.uint64(1)
        for at in range(0, len(hashes), 4096):
            block = hashes[at : at + 4096]
            for t in range(longs):
                counts[t] += np.unpackbits(mixed(block, t).view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            np.minimum(least, (factors[:, None] * block).min(axis=1), out=least)
        keys = np.arange(bands, dtype=np.uint64)
        for row in least.reshape(bands, rows).T:
            keys = mixed(keys + row, words)
    prints = np.packbits(2 * counts > len(hashes), axis=1).view(">i8")[:, 0].tolist()
    return same, prints, keys.view(np.int64).tolist(), np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def bits_of(similarity: float, bits: int, deviations: float = 4.5) -> int:
    """Most bits of `bits` in which SimHashes of two sets of that Jaccard similarity differ, so many standard deviations included."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def within_ring(a: Column, b: Column, longs: int, radius: int) -> Column:
    """Whether two arrays of `longs` 64-bit values differ in at most `radius` bits, by pigeonring: segments of 32 bits
    lie on a ring; some chain of consecutive segments has to keep to its proportional budget at each length up to
    half the ring, and then all bits are counted."""
    m = 2 * longs

    def piece(i: int) -> Column:
        return F.shiftrightunsigned(a[i // 2].bitwiseXOR(b[i // 2]), 32 * (i % 2)).bitwiseAND(F.lit((1 << 32) - 1))

    apart = [F.bit_count(piece(i)) for i in range(m)]
    chain = F.lit(False)
    for i in range(m):
        fits, total = F.lit(True), F.lit(0)
        for k in range(longs):
            total = total + apart[(i + k) % m]
            fits = fits & (total <= radius * (k + 1) // m)
        chain = chain | fits
    return chain & (sum(apart[1:], apart[0]) <= radius)


def ring_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows of x and y (64-bit words) that pass the test of within_ring()."""
    a, b = (np.ascontiguousarray(v).view(np.uint32) for v in (x, y))
    m = a.shape[1]
    apart = np.stack([np.bitwise_count(a[:, i, None] ^ b[None, :, i]) for i in range(m)]).astype(np.int16)
    chain = np.zeros(apart.shape[1:], bool)
    for i in range(m):
        total, fits = np.zeros(apart.shape[1:], np.int16), np.ones(apart.shape[1:], bool)
        for k in range(m // 2):
            total += apart[(i + k) % m]
            fits &= total <= radius * (k + 1) // m
        chain |= fits
    at, to = np.nonzero(chain)
    near = apart[:, at, to].sum(axis=0) <= radius
    return at[near], to[near]


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (low, high) whose shingle sets have that Jaccard similarity or more, counted in full."""
    one, two = (sets.select(F.col("node").alias(c), F.col("parts").alias(p)) for c, p in (("low", "x"), ("high", "y")))
    sides = pairs.join(two, "high").join(one, "low")
    both = F.size(F.array_intersect("x", "y"))
    return sides.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("low", "high")


def _open(placed: DataFrame, turn: int) -> tuple[DataFrame, int, float]:
    """Of rows (bucket, node, size, head, root): a stored table of the buckets that are open, their rows and open pairs.

    A bucket is open if rows other than its head, which all of them have met, lie in several components. A row of the
    table has the bucket, its n rows, their shingles `heft`, its largest component `top`, the n - `outer` rows of
    that, and up to 2 * HEADS heads drawn by hash, half of them from the outer rows. Only counts and minima by bucket
    and component are gathered.
    """
    draw = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HEADS + i)).alias("draw"), "node", "root")) for i in range(HEADS)]
    parts = placed.groupBy("bucket", "root").agg(
        F.count("*").alias("n"), F.sum("size").alias("heft"), F.count_if(F.expr("node <> head")).alias("others"), *[d.alias(f"h{i}") for i, d in enumerate(draw)]
    )
    tops = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("heft").alias("heft"), F.count_if(F.expr("others > 0")).alias("apart"),
        *[F.min(f"h{i}").alias(f"h{i}") for i in range(HEADS)],
    ).where("apart > 1")
    tops = tops.select("bucket", F.col("top.root").alias("top"), "n", "heft", (F.col("n") - F.col("top.n")).alias("outer"), *[f"h{i}" for i in range(HEADS)])
    away = parts.join(tops.select("bucket", "top"), "bucket").where("root <> top").groupBy("bucket").agg(*[F.min(f"h{i}").alias(f"o{i}") for i in range(HEADS)])
    heads = F.array_distinct(F.array(*[F.struct(f"{c}{i}.node", f"{c}{i}.root") for c in "ho" for i in range(HEADS)]))
    table = stored(tops.join(away, "bucket").select("bucket", "top", "n", "heft", "outer", heads.alias("heads")), "open", False)
    rows, pairs = table.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("outer"))).first()
    return table, rows or 0, pairs or 0.0


def _starred(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (low, high) of the heads of a bucket with its rows in other components: 2 * HEADS times the rows at most."""
    met = placed.join(small(open_.select("bucket", "heads"), 200), "bucket").select("node", "root", F.explode("heads").alias("h"))
    return met.where("root <> h.root").select(F.least("node", "h.node").alias("low"), F.greatest("node", "h.node").alias("high")).distinct()


def _celled(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows (bucket, i, j, outer, node, root): the rows of open buckets dealt over cells, so that each row outside a
    bucket's largest component (outer) shares a cell with every row of the bucket.

    A cell takes about CELL rows or HEFT shingles by side, so no bucket is one task.
    """
    heft = F.col("heft").cast("double") / F.col("n") / (HEFT / CELL)
    table = open_.select("bucket", "top", *[F.ceil(F.col(c) / CELL * F.greatest(F.lit(1.0), heft)).alias(d) for c, d in (("outer", "down"), ("n", "across"))])
    cut = placed.join(small(table, 48), "bucket")
    place = lambda seed, of: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    one = cut.where("root <> top").select("bucket", place(1, "down").alias("i"), every("across").alias("j"), F.lit(True).alias("outer"), "node", "root")
    two = cut.select("bucket", every("down").alias("i"), place(2, "across").alias("j"), F.lit(False).alias("outer"), "node", "root")
    return one.unionByName(two)


def _merges(fps: list[np.ndarray], sets: list[np.ndarray], roots: list[int], outer: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that a cell's rows link: at most one less than its roots, whatever the number of alike pairs."""
    first, second = np.flatnonzero(outer), np.flatnonzero(~outer)
    words = np.array(fps, np.int64).view(np.uint64)
    at, to = ring_pairs(words[first], words[second], radius)
    at, to = first[at], second[to]
    sizes, own = np.array([len(s) for s in sets]), np.array(roots)
    fits = (own[at] != own[to]) & (np.minimum(sizes[at], sizes[to]) >= similarity * np.maximum(sizes[at], sizes[to]))
    at, to = at[fits], to[fits]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for x in np.unique(at).tolist():
        mine = [y for y in to[at == x].tolist() if top(roots[y]) != top(roots[x])]
        if not mine:
            continue
        flat, ends = np.concatenate([sets[y] for y in mine]), np.cumsum([len(sets[y]) for y in mine])
        spot = np.searchsorted(sets[x], flat)
        hits = np.r_[0, np.cumsum(sets[x][np.minimum(spot, len(sets[x]) - 1)] == flat)] if len(sets[x]) else np.zeros(len(flat) + 1, np.int64)
        both = np.diff(np.r_[0, hits[ends]])
        union = len(sets[x]) + sizes[mine] - both
        for y in np.array(mine)[both >= similarity * union].tolist():
            a, b = sorted((top(roots[x]), top(roots[y])))
            if a != b:
                parent[b] = a
                out.append((a, b))
    return out


def _crossed(placed: DataFrame, open_: DataFrame, sketches: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (low, high) of roots that rows of open buckets make: each row outside a bucket's largest component is
    held against all rows of other components, cell by cell, by the ring first and then on whole sets."""
    cells = _celled(placed, open_).join(sketches, "node").select("bucket", "i", "j", "outer", "root", "fps", "parts")
    schema = pa.schema([("low", pa.int64()), ("high", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint32) for x in table.column("parts")]
        outer = table.column("outer").to_numpy(zero_copy_only=False).astype(bool)
        found = _merges(table.column("fps").to_pylist(), sets, table.column("root").to_pylist(), outer, radius, similarity)
        return pa.Table.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=schema)

    return cells.groupBy("bucket", "i", "j").applyInArrow(run, "low long, high long")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every row, linked where the Jaccard similarity of the word shingles is `similarity` or more.

    SimHashes of 256 bits prune candidates by pigeonring filtering before all bits are counted; what passes is
    decided on the whole shingle sets. At this similarity about 15 % of the bits differ, too many for equal
    segments to be keys, so rows are candidates where they share one of 24 keys, each of six minima of the shingles
    (missed in 0.07 % of pairs at 0.8, less above). In a bucket all rows meet the one of least identity. While many
    pairs of a bucket are still in different components, rounds of stars around heads drawn anew link them at a cost
    in proportion to its rows; at last every row outside a bucket's largest component is held against the rows of
    the others, within cells that give out links of components only. The rounds save work: they leave out no pair.
    Equal word sequences are one node. component_id is the least key reached, null where a group has only null keys.
    Null and wordless texts are equal and link; repeated rows come back repeated; an empty table gives no rows.
    """
    rows = narrowed(df, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("node", "fps", "keys", "parts")

    def run(ids: list, texts: list) -> dict:
        columns = zip(*[sketch(t, words) for t in texts], strict=True)
        return {"doc_id": ids} | dict(zip(names, map(list, columns), strict=True))

    prints = stored(map_texts(rows, run, f"doc_id {kind}, node long, fps array<long>, keys array<long>, parts array<int>"), "sketches")
    members = stored(prints.select("doc_id", "node"), "members", False)
    nodes = stored(prints.select("node", "keys", F.size("parts").alias("size")).groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size")), "nodes")
    entries = nodes.select("node", "size", F.explode("keys").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("bucket", "head")
    heads = stored(heads, "heads", False)
    met = stored(entries.join(small(heads, 32), "bucket"), "met")
    discard(heads, nodes)
    wanted = stored(met.select("node").distinct(), "wanted", False)
    sketches = prints.select("node", "fps", "parts").join(small(wanted, 16), "node", "left_semi")
    sketches = stored(sketches.groupBy("node").agg(F.first("fps").alias("fps"), F.first("parts").alias("parts")), "whole")
    discard(prints, wanted)
    radius = bits_of(similarity, 64 * LONGS)
    first, second = (sketches.select(F.col("node").alias(c), F.col("fps").alias(f)) for c, f in (("low", "f"), ("high", "g")))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that pass the ring and then the whole sets, in two written steps."""
        near = pairs.join(second, "high").join(first, "low").where(within_ring(F.col("f"), F.col("g"), LONGS, radius))
        near = stored(near.select("low", "high"), "near", False)
        found = stored(_alike(near, sketches, similarity), "alike")
        discard(near)
        return found

    links = linked(met.where("node <> head").select(F.col("head").alias("low"), F.col("node").alias("high")).distinct())
    roots, before = stored(components(links, "low", "high"), "roots", False), None
    discard(links)
    for turn in range(ROUNDS + 1):
        placed = met.join(small(roots, 32), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = stored(placed.select("bucket", "node", "size", "head", "root"), "placed", False)
        open_, count, pairs = _open(placed, turn)
        if not count:
            discard(placed, open_)
            break
        last = turn == ROUNDS or pairs <= FEW * count or before is not None and pairs > 0.8 * before
        if last:
            links = stored(_crossed(placed, open_, sketches, radius, similarity), "links")
        else:
            links = linked(_starred(placed, open_))
        discard(placed, open_)
        joined = roots.select(F.col("root").alias("low"), F.col("node").alias("high")).unionByName(links)
        grown = stored(components(joined, "low", "high"), "roots", False)
        discard(roots, links)
        roots, before = grown, pairs
        if last:
            break
    discard(met, sketches)
    held = stored(members.join(small(roots, 32), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "held", False)
    discard(members, roots)
    named = stored(held.groupBy("root").agg(F.min("doc_id").alias("component_id")), "named", False)
    return held.join(named, "root").select("doc_id", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df, all columns, that have the least key of their near-duplicate group (similar_groups).

    Rows that share the least key all stay, and of a group of null keys alone every row stays. What goes is a table of
    keys: if it measures small it is broadcast and texts are only read, else they are shuffled once by key.
    """
    groups = similar_groups(df, key, text, words, similarity)
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = stored(groups.groupBy("doc_id").agg(F.max(least).alias("stays")).where("NOT stays").select(F.col("doc_id").alias("_gone")), "gone")
    return df.join(small(gone, 24), df[key].eqNullSafe(gone["_gone"]), "left_anti")
