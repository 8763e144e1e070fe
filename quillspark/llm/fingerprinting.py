"""Document fingerprints by winnowing: rolling k-gram hashes and the minimum of each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import narrowed

#: Code points of a gram, grams of a window: any run of GRAM + WINDOW - 1 code points that two texts share is found.
GRAM, WINDOW = 12, 40
#: Positions handled at once; longer texts go in overlapping parts.
PART = 1 << 20
LOW32 = np.uint64(0xFFFFFFFF)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes mod 2**64 of all runs of `gram` symbols, by doubling, then mixed."""
    base = np.uint64(0xD6E8FEB86659FD93)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    total, length, power = None, 0, base
    piece, span, rest = mixed, 1, gram
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                if total is None:
                    total, length, shift = piece, span, power
                else:
                    n = len(points) - length - span + 1
                    total = total[:n] * power + piece[length : length + n]
                    length += span
            rest >>= 1
            if not rest:
                break
            n = len(piece) - span
            piece = piece[:n] * power + piece[span:]
            power, span = power * power, span * 2
        total = total ^ (total >> np.uint64(29))
        total = total * np.uint64(0xBF58476D1CE4E5B9)
        return total ^ (total >> np.uint64(32))


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of each window of `window` neighbours (of all, where there are fewer)."""
    window = min(window, len(keys))
    span = 1
    while 2 * span <= window:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (window - span)], keys[window - span :]) if window > span else keys


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the chosen grams: the minimum of each window, the rightmost of equals.

    A text shorter than a gram is one gram; an empty one has none.
    """
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    gram = min(gram, len(points))
    places, hashes, latest = [], [], -1
    grams = len(points) - gram + 1
    for start in range(0, max(1, grams - window + 1), PART):
        h = gram_hashes(points[start : start + PART + window + gram - 2], gram) >> np.uint64(32)
        keys = (h << np.uint64(32)) | (LOW32 - np.arange(len(h), dtype=np.uint64))
        least = window_minima(keys, window)
        least = least[np.r_[True, least[1:] != least[:-1]]]
        at = (LOW32 - (least & LOW32)).astype(np.int64) + start
        fresh = slice(int(at[0] == latest), None)
        latest = at[-1]
        places.append(at[fresh])
        hashes.append((least >> np.uint64(32)).astype(np.uint32)[fresh])
    return np.concatenate(places), np.concatenate(hashes)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(places: np.ndarray, hashes: np.ndarray) -> str:
    """Position and hash of each chosen gram, eight hexadecimal digits each."""
    return np.stack([places, hashes], axis=1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes by all distinct hashes; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def edited(text: str, follower: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + follower[:cut]


def with_followers(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows by descending key in ranges, each closed by a copy (follows = true) of the row that comes next.

    Range limits are quantiles of the key; the head of each range is its greatest key, and the heads, one number for
    a range, are all that reaches the driver. The last range is closed by the first row of all. Texts are shuffled
    once, each range to the task of its own number. Keys are integers (others fail); ties are ordered by text, null
    keys come last, and the rows of one key are neighbours in one range.
    """
    rows = narrowed(df, doc_id=key, text=text).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("place"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in rows.approxQuantile("place", [i / tasks for i in range(1, tasks)], 1 / (4 * tasks))}) if tasks > 1 else []

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = -np.searchsorted(np.array(cuts, np.int64), b.column("place").to_numpy(), side="left").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("place")], names=["part", "place"])

    heads = {r["part"]: r["head"] for r in rows.select("place").mapInArrow(ranged, "part long, place long").groupBy("part").agg(F.max("place").alias("head")).collect()}
    order = sorted(heads)
    wanted = {heads[p]: order[i - 1] for i, p in enumerate(order)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").to_numpy()
            at = -np.searchsorted(np.array(cuts, np.int64), place, side="left").astype(np.int64)
            out = [(at, b, False)]
            for i in np.flatnonzero(np.isin(place, np.array(list(wanted), np.int64))):
                out.append((np.array([wanted[int(place[i])]]), b.slice(i, 1), True))
            for part, piece, follows in out:
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([follows] * len(part)), *piece.columns], names=["part", "follows", *piece.schema.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(spread, f"part long, follows boolean, place long, doc_id {kind}, text string")
    return dealt.repartitionById(max(1, len(order)), (-F.col("part")).cast("int")).sortWithinPartitions("part", "follows", F.desc("place"), "text")


def compare(df: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses to it and to the next text.

    Null texts count as empty: no grams, an empty fingerprint. A single row is its own next. Repeated rows follow one
    another like any rows. Other columns are left out, and an empty table gives no rows.
    """
    import hashlib

    ordered = with_followers(df, key, text)
    fields = f"doc_id {ordered.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, own = None, None, None
        for b in batches:
            out = []
            for part, follows, doc_id, words in zip(*(b.column(c).to_pylist() for c in ("part", "follows", "doc_id", "text")), strict=True):
                if held is not None and held[0] == part and done != part:
                    places, hashes = own
                    chosen = winnow(points_of(words), gram, window)
                    other = edited(held[2], words)
                    e_places, e_hashes = winnow(points_of(other), gram, window)
                    out.append((held[1], len(held[2]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), as_text(places, hashes), as_text(e_places, e_hashes), likeness(hashes, e_hashes), likeness(hashes, chosen[1])))
                    own = chosen
                elif done != part:
                    own = winnow(points_of(words), gram, window)
                if follows:
                    done = part
                held = (part, doc_id, words)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return ordered.mapInArrow(run, fields)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
