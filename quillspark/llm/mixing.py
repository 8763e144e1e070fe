"""Mixing sources to target weights over a domain-language-source tree, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.tables import numbered
from quillspark.llm.common import WORD, discard, small, stored

LEVELS = ["domain", "lang", "source"]
#: Rows that a stretch of a leaf's seeded order holds on average.
STRETCH = 2048
#: The production targets: weights by domain and language; children without a weight count 1.
WEIGHTS = {"domain": {"web": 3.0, "curated": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {}}
SHARE, EPOCHS, SEED = 0.6, 2, "mix-1"


def domain_of(source: Column) -> Column:
    """The domain of a source: its number, if any, is even for curated and odd for web; without one it is web."""
    return F.when(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % 2 == 0, "curated").otherwise("web")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """A token budget for each leaf (LEVELS, tokens): the total is passed down the tree by weight.

    A node can take at most `epochs` times the tokens below it. What a child cannot take goes to its siblings by
    weight, and since each parent's own share is settled first, ancestors only see what no sibling could take. Among
    siblings the shares follow in closed form: in order of room by weight, those whose room is below the level that
    the rest would share are filled, and the others take the rest by weight. Children without tokens take nothing.
    """
    nodes = leaves.withColumn("room", F.col("tokens") * F.lit(epochs)).withColumn("given", total)
    for depth, level in enumerate(LEVELS):
        parents, path = LEVELS[:depth], LEVELS[: depth + 1]
        below = nodes.groupBy(*path).agg(F.sum("room").alias("room"), F.first("given").alias("given")).withColumn("weight", _weight(level, weights)).where("room > 0 AND weight > 0")
        order = Window.partitionBy(*parents).orderBy(F.col("room") / F.col("weight"), level)
        all_of = Window.partitionBy(*parents)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        below = below.withColumn("lift", (F.col("given") - F.coalesce(F.sum("room").over(earlier), F.lit(0))) / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
        filled = F.col("room") <= F.col("lift") * F.col("weight")
        level_at = F.min(F.when(~filled, F.struct(F.col("room") / F.col("weight"), F.col("lift")))).over(all_of)["lift"]
        below = below.withColumn("share", F.floor(F.coalesce(F.least(F.col("room").cast("double"), level_at * F.col("weight")), F.col("room").cast("double"))))
        nodes = nodes.drop("given").join(below.select(*[F.col(c).alias(f"_{c}") for c in path], F.col("share").alias("given")), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path])).drop(*[f"_{c}" for c in path])
    return nodes.select(*LEVELS, "tokens", "n", F.col("given").cast("long").alias("budget"))


def mix(df: DataFrame, weights: dict | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of df that name a leaf, with tokens, epoch, budget and start: the documents that make up the mix.

    df needs columns lang and source (and may have domain). The total is `share` of all tokens (words of a text).
    In each epoch a leaf's documents follow in the order of a seeded hash of epoch and key; a leaf takes whole epochs
    while its budget lasts and of the next one the prefix of documents that begin before the budget is used up.
    Null texts have no tokens and are never taken, and neither are texts without words; null languages and sources
    are leaves of their own. Ties in the order are settled by key and length. Rows alike in these are taken one by
    one, in the order of their texts, so that a leaf passes its budget by less than its last document.
    Columns of df outside the tree come back unchanged; an empty table gives no rows.

    A leaf may hold any share of the rows: its order is cut into stretches of about STRETCH rows, whose token sums
    tell the stretch that the budget ends in, and only that stretch is sorted. What comes of it is one limit for each
    leaf and epoch, a stored table: if it measures small, as with any number of leaves below some 80,000, it is
    broadcast and texts are only read, each row held against the limit of its leaf; else both are shuffled by leaf, and
    adaptive execution splits large leaves.
    """
    names = df.columns
    domain = F.col("domain") if "domain" in names else domain_of(F.col("source"))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = stored(df.select(domain.alias("domain"), "lang", "source", F.col(key).alias("_key"), tokens.alias("tokens")), "mixing")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, F.lit(float(int(whole * share))), weights or WEIGHTS, epochs)
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("left", F.col("budget") - F.col("epoch") * F.col("tokens")).where("left > 0")
    plan = stored(plan.select(*LEVELS, "epoch", "left", "budget", (F.floor((F.col("n") - 1) / STRETCH) + 1).alias("stretches"), (F.col("left") >= F.col("tokens")).alias("full")), "plan")
    spot = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("_key").cast("string"), F.lit("null"))).cast("binary"))
    met = _by_leaf(narrow.where("tokens > 0"), plan.where("NOT full")).withColumn("spot", spot)
    met = met.withColumn("stretch", F.floor(F.conv(F.substring("spot", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.col("stretches")))
    sums = met.groupBy(*LEVELS, "epoch", "stretch").agg(F.sum("tokens").alias("sum"), F.first("left").alias("left"))
    before = Window.partitionBy(*LEVELS, "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).where("base < left")
    last = sums.groupBy(*LEVELS, "epoch").agg(F.max(F.struct("stretch", "base")).alias("last"))
    edge = _by_leaf(met, last, "epoch").where("stretch = last.stretch")
    alike = ["spot", "_key", "tokens"]
    edge = edge.groupBy(*LEVELS, "epoch", *alike, "left", F.col("last.base").alias("base")).agg(F.count("*").alias("copies"))
    inside = Window.partitionBy(*LEVELS, "epoch").orderBy(*alike).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.col("base") + F.coalesce(F.sum(F.col("tokens") * F.col("copies")).over(inside), F.lit(0))).where("start < left")
    part = F.least("copies", F.ceil((F.col("left") - F.col("start")) / F.col("tokens")).cast("long"))
    limits = edge.groupBy(*LEVELS, "epoch").agg(F.max(F.struct(*alike)).alias("limit"), F.max_by(F.struct(part.alias("taken"), "copies"), F.struct(*alike)).alias("last"))
    ends = _by_leaf(plan, limits, "epoch", how="left").select(*LEVELS, "epoch", "budget", "full", "limit", F.when(F.col("last.taken") < F.col("last.copies"), F.col("last.taken")).alias("some"))
    ends = stored(ends, "ends")
    discard(narrow, plan)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), domain.alias("domain"), F.col("lang"), F.col("source"), F.col(key).alias("_key"), tokens.alias("tokens")).where("tokens > 0")
    here = F.struct(*alike)
    met = _by_leaf(rows, small(ends, 400)).withColumn("spot", spot)
    taken = met.where(F.col("full") | (here < F.col("limit")) | ((here == F.col("limit")) & F.col("some").isNull()))
    if not ends.where("some IS NOT NULL").isEmpty():
        last = met.where(~F.col("full") & (here == F.col("limit")) & F.col("some").isNotNull()).withColumn("_order", F.col(f"_row.{text}"))
        taken = taken.unionByName(numbered(last, [*LEVELS, "epoch"], ["_order"], "_n", most=0).where("_n <= some").select(*taken.columns))
    extra = [c for c in ("domain", "tokens", "epoch", "budget") if c not in names]
    return taken.select("_row.*", *extra)


def _by_leaf(rows: DataFrame, table: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """rows joined to a table of leaves, null names matching; Spark broadcasts the table if it measures small."""
    keys = [*LEVELS, *more]
    named = table.select(*[F.col(c).alias(f"_leaf_{c}") for c in keys], *[c for c in table.columns if c not in keys])
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_leaf_{c}")) for c in keys]), how).drop(*[f"_leaf_{c}" for c in keys])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to the production targets: 0.6 of all tokens, at most two epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "domain", "lang", "source", "tokens", "epoch", "budget")


def _case(level: str) -> str:
    inner = " ".join(f"WHEN {level} = '{name}' THEN {w}" for name, w in WEIGHTS[level].items())
    return f"CASE {inner} ELSE 1.0 END::DOUBLE" if inner else "1.0::DOUBLE"


def _level_sql(depth: int) -> str:
    """One level of the tree: (path, share) from the level above, by the closed form of the shares."""
    path, level = ", ".join(LEVELS[: depth + 1]), LEVELS[depth]
    above = " AND ".join(f"l.{c} IS NOT DISTINCT FROM p.{c}" for c in LEVELS[:depth]) or "true"
    part = f"PARTITION BY {', '.join(LEVELS[:depth])} " if depth else ""
    return f"""
c{depth} AS (SELECT {path}, room, given, {_case(level)} AS weight FROM (SELECT {", ".join(f"l.{c}" for c in LEVELS[: depth + 1])}, sum(l.tokens * {EPOCHS}) AS room, any_value(p.share) AS given FROM leaves l JOIN p{depth} p ON {above} GROUP BY ALL) WHERE room > 0),
o{depth} AS (SELECT *, (given - coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lift FROM c{depth} WINDOW w AS ({part}ORDER BY room / weight, {level} NULLS FIRST)),
m{depth} AS (SELECT *, arg_min(lift, room / weight) FILTER (room > lift * weight) OVER ({part}) AS common FROM o{depth}),
p{depth + 1} AS (SELECT {path}, floor(coalesce(least(room::DOUBLE, common * weight), room::DOUBLE)) AS share FROM m{depth}),"""


#: DuckDB SQL for op3_mixing: the same shares, and the prefixes by plain running sums.
ORACLE = rf"""
WITH d AS (SELECT doc_id, CASE WHEN try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 2 = 0 THEN 'curated' ELSE 'web' END AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
p0 AS (SELECT trunc(sum(tokens) * {SHARE}::DOUBLE)::DOUBLE AS share FROM leaves),
{"".join(_level_sql(i) for i in range(3))}
plan AS (SELECT l.domain, l.lang, l.source, l.tokens AS all_tokens, p.share::BIGINT AS budget, e.epoch FROM leaves l JOIN p3 p ON {" AND ".join(f"l.{c} IS NOT DISTINCT FROM p.{c}" for c in LEVELS)} CROSS JOIN (SELECT unnest(range({EPOCHS}))::INT AS epoch) e),
met AS (SELECT d.*, plan.epoch, plan.budget, coalesce(sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source, plan.epoch
  ORDER BY md5('{SEED}:' || plan.epoch || ':' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  plan.budget - plan.epoch * plan.all_tokens AS left_over
  FROM d JOIN plan ON {" AND ".join(f"d.{c} IS NOT DISTINCT FROM plan.{c}" for c in LEVELS)} WHERE d.tokens > 0)
SELECT doc_id, domain, lang, source, tokens, epoch, budget FROM met WHERE start < left_over
"""
