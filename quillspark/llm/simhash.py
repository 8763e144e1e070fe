"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import components, discard, map_texts, narrowed, stored

SEED = 42


def fingerprint(text: str, words: int = 3, tables: int = 1) -> list[int]:
    """The signed 64-bit SimHashes of a text; 0 without words, one shingle of all words where there are fewer.

    The first is made of the shingles' XXH64; each further table mixes those hashes anew.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return [0] * tables
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    elif words == 3:
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % s, SEED) for s in zip(found, found[1:], found[2:], strict=False)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*[found[i:] for i in range(words)], strict=False)]
    counts = np.zeros((tables, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.array(hashes[at : at + (1 << 15)], dtype=np.uint64)
        for t in range(tables):
            turned = block if not t else mixed(block, t)
            counts[t] += np.unpackbits(turned.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), axis=1).view(">i8")[:, 0].tolist()


def mixed(h: np.ndarray, table: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * table)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, tables: int = 1) -> DataFrame:
    """doc_id and fps (an array, one fingerprint for each table) of every row, from whole texts; null texts are empty."""
    rows = narrowed(df, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, lambda ids, texts: {"doc_id": ids, "fps": [fingerprint(t, words, tables) for t in texts]}, f"doc_id {kind}, fps array<long>")


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a < b) of values of column fp, within a table, that differ in at most `radius` bits: rows (table, a, b).

    The 64 bits are a ring of m = radius + 1 segments. If two fingerprints differ in at most radius bits, some
    segment starts a chain whose first 1, 2, ... segments differ in at most radius * 1/m, radius * 2/m, ... bits
    (strong pigeonring). So the first segment of the chain is equal (floor(radius/m) = 0) and the first two differ
    in floor(2 * radius / m) bits, 1 for a radius over 1: one side is looked up by both segments as they are, the
    other by the first and all variants of the second. What meets is filtered by the longer chains and then by all
    bits. Rows grow linearly, 3 * 23 for a fingerprint at radius 2; no bucket is paired with itself.
    """
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    budget = [radius * k // m for k in range(m + 1)]
    fp = F.col("fp")

    def piece(value, i: int):
        low, width = cuts[i % m], cuts[i % m + 1] - cuts[i % m]
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else value

    def flips(i: int) -> list[int]:
        width = cuts[(i + 1) % m + 1] - cuts[(i + 1) % m]
        return _flips(width, budget[2]) if m > 1 else [0]

    def key(i: int, second):
        return F.struct(F.lit(i).alias("ring"), piece(fp, i).alias("first"), second.alias("second"))

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("table", "fp").distinct().repartition(tasks)  # narrow rows, before each becomes 69
    plain = distinct.select("table", fp.alias("b"), F.explode(F.array(*[key(i, piece(fp, i + 1)) for i in range(m)])).alias("k"))

    def variants(i: int):
        masks = F.array(*[F.lit(x).cast("long") for x in flips(i)])
        return F.transform(masks, lambda mask: key(i, piece(fp, i + 1).bitwiseXOR(mask)))

    tried = distinct.select("table", fp.alias("a"), F.explode(F.concat(*[variants(i) for i in range(m)])).alias("k"))
    keyed = [x.select(c, F.col("table").alias(t), F.xxhash64("table", "k.ring", "k.first", "k.second").alias("h")) for x, c, t in ((tried, "a", "table"), (plain, "b", "other"))]
    apart = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(m):
        fits, total = F.lit(True), F.lit(0)
        for k in range(m):
            total = total + F.bit_count(piece(apart, i + k))
            fits = fits & (total <= budget[k + 1])
        chain = chain | fits
    return keyed[0].join(keyed[1], "h").where("a < b AND table = other").where(chain).where(F.bit_count(apart) <= radius).select("table", "a", "b").distinct()


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, tables: int = 1) -> DataFrame:
    """doc_id, fps and component_id of every row.

    Rows link if their fingerprints of any table differ in at most `radius` bits. component_id is the least key of
    the rows reached over links, the row's own included; null keys name no component, so a component of null keys
    alone has a null id. Equal texts share their fingerprints; texts without words have fingerprint 0 and link like
    any other. Repeated rows come back repeated; an empty table gives no rows. Copies meet as one node: pairs are
    sought between distinct fingerprints only, and nodes that share a fingerprint link to one of them.
    """
    prints = stored(fingerprints(df, key, text, words, tables).withColumn("node", F.col("fps")[0] if tables == 1 else F.xxhash64("fps")), "fingerprints")
    nodes = prints.groupBy("node").agg(F.first("fps").alias("fps"), F.min("doc_id").alias("least"))
    values = nodes.select("node", F.posexplode("fps").alias("table", "fp"))
    holder = values.groupBy("table", "fp").agg(F.min("node").alias("holder"))
    found = links(holder, radius)
    edges = found.join(holder.select("table", F.col("fp").alias("a"), F.col("holder").alias("low")), ["table", "a"]).join(holder.select("table", F.col("fp").alias("b"), F.col("holder").alias("high")), ["table", "b"]).select("low", "high")
    if tables > 1:
        edges = edges.unionByName(values.join(holder, ["table", "fp"]).select(F.col("holder").alias("low"), F.col("node").alias("high")))
    roots = components(edges, "low", "high")
    held = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = held.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(held.join(named, "root").select("node", "component_id"), "node").select("doc_id", "fps", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word fingerprints of all documents and the components of links at two bits or fewer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, words=3, radius=2).select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
