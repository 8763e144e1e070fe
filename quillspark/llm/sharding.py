"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, by weighted hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a numbering group holds on average.
GROUP_ROWS = 4096


def uniform_tree(shards: int, racks: int = 2, width: int = 4) -> list[list[list[tuple[int, float]]]]:
    """Regions of `racks` racks of `width` shards each, filled in order; every shard has weight 1."""
    tree: list[list[list[tuple[int, float]]]] = []
    for shard in range(shards):
        if shard % (racks * width) == 0:
            tree.append([])
        if shard % width == 0:
            tree[-1].append([])
        tree[-1][-1].append((shard, 1.0))
    return tree


def with_shard(tree: list[list[list[tuple[int, float]]]], weight: float = 1.0) -> list[list[list[tuple[int, float]]]]:
    """The tree with one more shard, a region of its own: no other subtree changes, so rows move only into the new shard."""
    return [*tree, [[(sum(len(rack) for region in tree for rack in region), weight)]]]


def _draw(key: Column, salt: str, weight: float) -> Column:
    """An exponential draw: the child with the least -ln(u)/weight wins in proportion to its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)


def _least(draws: list[Column]) -> Column:
    """The index of the least draw; ties go to the lower index."""
    if len(draws) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("at")) for i, d in enumerate(draws)]))["at"]


def place(key: Column, tree: list[list[list[tuple[int, float]]]], seed: str = "shards") -> Column:
    """The shard of a key. A child's draw depends on the key and the child's name only.

    Raising the weight of a subtree therefore only attracts keys to it; keys whose draws are still won by another
    child stay, with all their lower levels. Children of weight 0 take nothing. A null key is a key like any other.
    """

    def weight(node) -> float:
        return node[1] if isinstance(node, tuple) else sum(weight(x) for x in node)

    def descend(node: list, name: str) -> Column:
        alive = [(i, x) for i, x in enumerate(node) if weight(x) > 0]
        below = [F.lit(x[0]) if isinstance(x, tuple) else descend(x, f"{name}/{i}") for i, x in alive]
        if len(below) == 1:
            return below[0]
        names = [f"{name}/shard{x[0]}" if isinstance(x, tuple) else f"{name}/{i}" for i, x in alive]
        won = _least([_draw(key, n, weight(x)) for n, (_, x) in zip(names, alive, strict=True)])
        out = F.when(won == 0, below[0])
        for i, x in enumerate(below[1:], 1):
            out = out.when(won == i, x)
        return out

    return descend(tree, seed).cast("int")


def shard(df: DataFrame, tree: list, grown: list | None = None, key: str = "doc_id", text: str = "text", seed: str = "shards") -> DataFrame:
    """key, size (UTF-8 bytes + 1; null text: 1), text_crc32, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots are numbered by key within groups of a shard's rows, whose offsets come from counts: no shard is sorted
    in one task. Equal keys, copies included, share a shard; rows alike in every value get distinct slots. Texts
    are not shuffled. Other columns of df, whatever their names, are left out. An empty table gives no rows.
    """
    raw = F.coalesce(df[text], F.lit("")).cast("binary")
    rows = df.select(df[key].alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    leaves = sum(len(rack) for region in tree for rack in region)
    groups = max(1, -(-df.select(F.count("*")).first()[0] // (leaves * GROUP_ROWS)))
    placed = rows.select("*", place(F.col("doc_id"), tree, seed).alias("shard"), (place(F.col("doc_id"), grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", F.lit(f"{seed}:group")), F.lit(groups)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by doc_id; grown_shard is the shard after one more was added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs, uniform_tree(16), with_shard(uniform_tree(16)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
