"""Quality by compression: zstandard dictionaries of good and bad labelled text, and a calibrated size difference."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_texts, narrowed
from quillspark.llm.quality_rules import labelled

#: Labelled rows that the dictionaries and the calibration take at most, blocks drawn of each text for a dictionary, dictionary size.
SAMPLE, DRAWN, SIZE = 8_000, 8, 112_640
#: Texts are compressed in blocks of so many bytes, each against the dictionary, so that long texts don't outlearn it.
BLOCK = 2_048


def dictionary(texts: list[bytes], size: int = SIZE) -> bytes:
    """A trained dictionary of blocks of text; whole blocks by their hashes where they are too few or too small to train on."""
    try:
        return zstandard.train_dictionary(size, texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        out = b""
        for piece in sorted(texts, key=xxhash.xxh64_intdigest):
            out += piece if len(out) + len(piece) <= size else b""
        return out or texts[0][:size]


def blocks(text: str, most: int = DRAWN) -> list[bytes]:
    """At most `most` of a text's blocks, drawn from the whole text by the hash of what they hold and where they stand."""
    raw = text.encode("utf-8", "surrogatepass")
    cut = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    chosen = sorted(range(len(cut)), key=lambda i: (xxhash.xxh64_intdigest(cut[i], i), i))[:most]
    return [cut[i] for i in sorted(chosen)]


@dataclass
class Compressor:
    good: bytes
    bad: bytes
    slope: float = 1.0
    shift: float = 0.0

    def differences(self, texts: list[str]) -> np.ndarray:
        """(size under bad - size under good) / larger of both, over all blocks of each whole text; 0 without text."""
        made = [zstandard.ZstdCompressor(level=3, dict_data=_loaded(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for n, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in made)
            out[n] = (bad - good) / max(good, bad, 1)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.shift, -30, 30)))


def _loaded(content: bytes) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(content)
    out.precompute_compress(level=3)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's steps, lightly held towards 0."""
    scale = float(np.std(x)) or 1.0
    a, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - y) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Compressor:
    """Dictionaries from one half of a bounded labelled sample, the calibration from the other half's whole texts.

    Of at most `most` rows, those with the least key hashes, DRAWN blocks each reach the driver for the dictionaries,
    drawn by hash from the whole text. With no labelled rows, or one label only, every score is the share of good rows (0.5 of none).
    """
    sample = labelled(docs, labels, key, text, most=most).select("y", "text", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"), "doc_id")
    first = sample.where("half = 0").select(F.col("y").alias("doc_id"), "text")
    shown = map_texts(first, lambda ys, texts: {"y": ys, "blocks": [blocks(t) for t in texts]}, "y int, blocks array<binary>").collect()
    shown = sorted((r["y"], [bytes(b) for b in r["blocks"]]) for r in shown if r["blocks"])
    good, bad = ([b for y, cut in shown for b in cut if y == label] for label in (1, 0))
    n_good = sum(y == 1 for y, _ in shown)
    share = np.clip((n_good or 0.5) / (len(shown) or 1), 1e-3, 1 - 1e-3)
    if not good or not bad:
        return Compressor(b"".join(good)[:SIZE] or b"good", b"".join(bad)[:SIZE] or b"bad", 0.0, float(np.log(share / (1 - share))))
    model = Compressor(dictionary(good), dictionary(bad))
    rest = map_texts(sample.where("half = 1").select(F.col("y").alias("doc_id"), "text"), lambda ys, texts: {"y": ys, "x": model.differences(texts)}, "y int, x double")
    found = np.array(sorted((r["x"], r["y"]) for r in rest.collect()), np.float64).reshape(-1, 2)
    if len(found) and 0 < found[:, 1].mean() < 1:
        model.slope, model.shift = calibrate(found[:, 0], found[:, 1])
    return model


def classify(docs: DataFrame, model: Compressor, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row, from its whole text alone.

    Null and empty texts differ by 0 and get the curve's shift; repeated rows, ties and other columns play no part.
    An empty table gives no rows.
    """

    def run(ids: list, texts: list) -> dict:
        score = model.scores(texts)
        return {"doc_id": ids, "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(narrowed(docs, doc_id=key, text=text), run, f"doc_id {kind}, score double, predicted int")


def held_out():
    """Whether a row stays out of all learning: crc32 of the key as text, mod 3, is 1 (a null key: it stays out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labelled rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
