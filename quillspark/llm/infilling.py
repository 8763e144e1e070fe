"""Fill-in-the-middle transformation over an index of distinct texts with Elias-Fano lists of line boundaries."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small, stored

#: The marks of prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the cuts, percentage of texts that are cut at all, percentage of those with the suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50


# Elias-Fano lists
def boundaries(text: str) -> np.ndarray:
    """Where the lines of a text end, in code points, after a 0: n + 1 rising numbers for n lines; the last line may lack its \\n."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    rest = [] if not text or text.endswith("\n") else [len(text)]
    return np.concatenate([[0], ends, rest]).astype(np.int64)


def encode(values: np.ndarray) -> bytes:
    """A rising list as Elias-Fano bytes: count and width of the low bits, the low bits packed, the high parts in unary.

    Number i has the bit (high part + i) set in the upper vector, so that n numbers up to u take about 2 + log2(u / n)
    bits each.
    """
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    high = np.zeros((top >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return np.array([n, width], "<i8").tobytes() + np.packbits(low, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


def count(held: bytes) -> int:
    """How many numbers a list holds."""
    return int(np.frombuffer(held, "<i8", 1)[0])


def select(held: bytes, i: int) -> int:
    """Number i of a list: the place of the upper vector's set bit i, found by counts of bytes, and its low bits."""
    n, width = np.frombuffer(held, "<i8", 2)
    packed = np.frombuffer(held, np.uint8, offset=16)
    cut = (int(n) * int(width) + 7) // 8
    upper = packed[cut:]
    before = np.cumsum(ONES[upper])
    byte = int(np.searchsorted(before, i + 1))
    inside = np.flatnonzero(np.unpackbits(upper[byte], bitorder="little"))[i - int(before[byte] - ONES[upper[byte]])]
    high, low = byte * 8 + int(inside) - i, 0
    for bit in range(int(width)):
        at = i * int(width) + bit
        low |= (int(packed[at >> 3]) >> (at & 7) & 1) << bit
    return high << int(width) | low


@F.arrow_udf(T.BinaryType())
def listed(content: pa.Array) -> pa.Array:
    """The boundary list of each text."""
    return pa.array([encode(boundaries(t.as_py())) for t in content], pa.binary())


# Cuts
def chosen(seed: int, rate: int, suffix_first: int):
    """An Arrow function from key and boundary list to n, form, start and end, the place of the middle in code points.

    Four draws from SHA-256 of seed and key give both cuts, whether the text is cut at all, and its form.
    """

    def pick(key: str, held: bytes) -> tuple[int, str, int, int]:
        n = count(held) - 1
        digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
        draws = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        start, end = (select(held, i) for i in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
        return n, "plain" if draws[2] % 100 >= rate else "spm" if draws[3] % 100 < suffix_first else "psm", start, end

    kinds = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    @F.arrow_udf(kinds)
    def cuts(key: pa.Array, bounds: pa.Array) -> pa.Array:
        rows = [pick(k.as_py(), b.as_py()) for k, b in zip(key, bounds, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["n", "form", "start", "end"])

    return cuts


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of; marks cannot occur in texts that are cut."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def index(texts: DataFrame) -> DataFrame:
    """(digest, content, bounds), one row for each distinct text of rows (digest, content): its boundary list, made once.

    Rows are grouped by the digest and by the whole text, so equal digests of different texts stay apart. Copies meet
    as partial groups of each task.
    """
    distinct = texts.groupBy("digest", "content").agg(F.count("*").alias("copies"))
    return distinct.select("digest", "content", listed("content").alias("bounds"))


def infilled(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): every row's text cut at two line ends and put in a new order.

    The cuts are draws by seed and key among the ends of the text's n lines; the smaller ends the prefix, the larger
    the middle. Null texts are empty, and empty texts and those that hold a mark are plain, as they are. Rows without
    a key draw by the word null; rows alike in key and text are cut alike and come as often as they are there. Other
    columns of df play no part, and an empty table gives no rows.

    Boundary lists belong to distinct texts. Digests that occur more than once are counted first, on narrow rows; the
    texts behind them are grouped by content in index(), and their documents joined back to it by digest and content, a
    plain shuffle that adaptive execution splits where one text holds many rows; only their keys and lists, not the
    texts, go to Python. A text that occurs once is its own
    entry: its list is made where it is read, and nothing is shuffled. The repeated digests are broadcast only if they
    measure small; beyond that both sides of that question are shuffled.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), content.alias("content"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"))
    shared = stored(rows.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest"), "repeated")
    known = small(shared, 64)
    single = rows.join(known, "digest", "left_anti").select("key", "content", listed("content").alias("bounds"))
    copies = rows.join(known, "digest", "left_semi")
    entries = stored(index(copies), "distinct")
    back = copies.join(entries.select(F.col("digest").alias("_digest"), F.col("content").alias("_content"), "bounds"), (F.col("digest") == F.col("_digest")) & (F.col("content") == F.col("_content")))
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    made = single.unionByName(back.select("key", "content", "bounds")).withColumn("cut", chosen(seed, rate, suffix_first)(name, F.col("bounds")))
    start, end, marked = F.col("cut.start"), F.col("cut.end"), F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("content").contains(mark)
    made = made.withColumn("form", F.when((F.col("content") == "") | marked, "plain").otherwise(F.col("cut.form")))
    prefix, middle, suffix = F.left("content", start), F.substring("content", start + 1, end - start), F.substring("content", end + 1, F.length("content"))
    output = F.when(F.col("form") == "plain", F.col("content")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    sizes = [F.when(F.col("form") != "plain", size.cast("long")).alias(name) for name, size in (("prefix_chars", start), ("middle_chars", end - start))]
    return made.select(F.col("key").alias(key), F.col("cut.n").alias("n"), "form", *sizes, output.alias("output"))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents transformed, with digests of the outputs and of the texts rebuilt from them."""
    made = infilled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: DuckDB SQL for op11_infilling: lines as lists, cut at the same draws.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, [('0x' || h[8 * i + 1 : 8 * i + 8])::UBIGINT::BIGINT FOR i IN range(4)] AS r FROM d),
y AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r[3] % 100 >= {RATE} THEN 'plain' WHEN r[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM z
"""
