"""Packing tokenised documents into sequences: first-fit decreasing with a tournament tree, group by group."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_texts, narrowed, stored

#: Tokens of a sequence, pieces that a group holds on average, and the id that ends a document.
SEQUENCE, GROUP, END = 1024, 4096, 0
#: Texts of these characters alone are split alike by both libraries; others go through the tokenizer file itself.
PLAIN = re.compile("[\x00-ɏ‐-‧€]*")
#: Runs of white space that the rank file's library cannot split without running out of stack (from some 200,000 on).
BLANK = re.compile(r"\s{4096}")


def encoder(name: str):
    """A function from a text to its ids, by the public tokenizer file `name`.json.

    The rank file of the same vocabulary gives the same ids several times faster; texts with rarer characters, special
    tokens or very long white space, and vocabularies without a rank file, go through the tokenizer file. What is loaded is kept on
    the imported module, where a worker's later tasks find it.
    """
    import os

    import public_tokenizers

    held = public_tokenizers.__dict__.setdefault("_quillspark", {})

    def whole():
        if ("whole", name) not in held:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            held["whole", name] = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        return held["whole", name]

    ranks = public_tokenizers.path(f"{name}.tiktoken")
    if not os.path.exists(ranks):
        return lambda text: whole().encode(text, add_special_tokens=False).ids
    if name not in held:
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        held[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    fast = held[name].encode_ordinary

    def encode(text: str):
        if PLAIN.fullmatch(text) and "<|endoftext|>" not in text and not BLANK.search(text):
            return fast(text)
        return whole().encode(text, add_special_tokens=False).ids

    return encode


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and END, cut every `size` ids."""

    def run(keys: list, texts: list) -> dict:
        encode = encoder(tokenizer)
        out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
        for k, t in zip(keys, texts, strict=True):
            ids = np.array([*encode(t), END], dtype="<u4")
            for start in range(0, len(ids), size):
                piece = ids[start : start + size]
                for name, value in zip(out, (k, start, len(piece), zlib.crc32(piece), len(ids)), strict=True):
                    out[name].append(value)
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_texts(narrowed(df, doc_id=key, text=text), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, taken in order, in the first bin with room.

    A tournament tree over the bins' free room finds that bin: each inner node holds the larger room of its two
    children, and the search goes left wherever the left child has room enough.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [size] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < n:
                at += 1
        bins.append(at - leaves)
        offsets.append(size - room[at])
        room[at] -= n
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pack(cut: DataFrame, size: int = SEQUENCE, group: int = GROUP, seed: str = "packing") -> DataFrame:
    """sequence_id and offset for each row of pieces(): offsets are gapless from 0 in each sequence.

    Pieces are dealt by a seeded hash into groups of about `group` rows, each packed in one task on its own, longest
    first, ties by key and start. Rows alike in every column are counted and numbered, and the number is part of the
    hash: whatever share one key or one repeated row holds, its pieces are spread over the groups.
    """
    groups = max(1, -(-cut.select(F.count("*")).first()[0] // group))
    apart = cut.groupBy(*cut.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt = apart.select(*cut.columns, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy", F.lit(seed)), F.lit(groups)).alias("deal"))

    def run(table):
        import pyarrow as pa

        rows = table.drop_columns(["deal"]).to_pylist()
        deal = table.column("deal")[0].as_py()
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is None, [] if r["doc_id"] is None else [r["doc_id"]], r["start"], r["ids_crc32"]))
        bins, offsets = first_fit([r["length"] for r in rows], size)
        out = pa.Table.from_pylist(rows, schema=table.drop_columns(["deal"]).schema)
        return out.append_column("sequence_id", pa.array([deal * (1 << 24) + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("deal").applyInArrow(run, ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long")


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Pieces of all rows of df and their places.

    Null and empty texts are the single id END; long texts are cut into full pieces and a rest. Repeated rows are
    packed as often as they come, other columns are left out, and an empty table gives no rows.
    """
    return pack(stored(pieces(df, key, text, size), "pieces"), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
