"""Chat formatting of reply trees: paths from roots to leaves by self-joins, the best branches formatted, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.tables import numbered
from quillspark.llm.common import stored

#: The template's control strings: a turn is OPEN HEAD role BODY text CLOSE.
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"
#: Shares that the branches of a tree are dealt into before the best of all are chosen.
SHARES = 64


# Template
def escaped(text: Column) -> Column:
    r"""A text without control strings: one backslash more behind the < or [ of each, however many stand there already."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(?=/?s>)", r"<\\$1"), r"\[(\\*)(?=/?INST\])", r"[\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)(?=/?s>)", "<$1"), r"\[\\(\\*)(?=/?INST\])", "[$1")


def formatted(turns: DataFrame, path: list[str], place: str = "place", role: str = "role", text: str = "text") -> DataFrame:
    """(path, n_turns, formatted, mask): the turns of each path in order as one string, and the place of every text in it.

    mask has (start, length, loss) for the text of each turn, in code points from 0, as it stands in the string; loss
    is true for the assistant's. Null roles and texts are empty. The string of a path is one value, as any formatted
    conversation is; starts come from running sums of lengths.
    """
    head = F.concat(F.lit(OPEN + HEAD), escaped(F.coalesce(F.col(role), F.lit(""))), F.lit(BODY))
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    rows = turns.select(*path, F.col(place).alias("_place"), head.alias("_head"), body.alias("_body"), F.coalesce(F.col(role) == LEARNT, F.lit(False)).alias("_loss"))
    rows = rows.withColumn("_size", (F.length("_head") + F.length("_body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy(*path).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)) + F.length("_head"))
    piece = F.struct("_place", F.concat("_head", "_body", F.lit(CLOSE)).alias("piece"), F.struct(F.col("_start").alias("start"), F.length("_body").alias("length"), F.col("_loss").alias("loss")).alias("span"))
    out = rows.groupBy(*path).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    return out.select(*path, F.size("_p").cast("long").alias("n_turns"), F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("formatted"), F.transform("_p", lambda x: x["span"]).alias("mask"))


def turns_of(output: DataFrame, path: list[str]) -> DataFrame:
    """(path, turn, role, text, learnt) read back from formatted(): role and text by the control strings, learnt by the mask.

    learnt is the text under the mask, unescaped, null outside it. Each string is cut at its turns once.
    """
    pieces = F.split("formatted", CLOSE, -1)
    rows = output.select(*path, F.posexplode(F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"), F.col("mask").alias("span"))).alias("turn", "x")).select(*path, "turn", "x.piece", "x.span")
    before = Window.partitionBy(*path).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece") + len(CLOSE)).over(before), F.lit(0))
    rest = F.substring("piece", len(OPEN + HEAD) + 1, 1 << 30)
    role = F.substring_index(rest, BODY, 1)
    text = F.substring(rest, F.length(role) + len(BODY) + 1, F.length(rest))
    learnt = F.when(F.col("span.loss"), unescaped(F.substring(F.col("piece"), (F.col("span.start") - start + 1).cast("int"), F.col("span.length").cast("int"))))
    return rows.select(*path, "turn", unescaped(role).alias("role"), unescaped(text).alias("text"), learnt.alias("learnt"))


# Trees
def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links from each message to the one 2^k above it, for k from 0, and (id, hops, total) up to the root.

    nodes(id, up, score): up is the id of the message answered, or null. Each round joins the links to themselves, so
    that they reach twice as far: the rounds are as many as the binary digits of the deepest tree's depth, and a round
    only has the messages that lie so deep. Messages that never come to a root, because replies answer each other in a
    circle, have no links and are roots themselves.
    """
    base = stored(nodes.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("score").alias("total")), "links")
    ended, open_ = [base.where("up IS NULL")], base.where("up IS NOT NULL")
    links, left = [open_], None
    while (now := open_.count()) and now != left:
        whole = reduce(DataFrame.unionByName, [*ended, open_]).select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("total").alias("_total"))
        level = open_.join(whole, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("total") + F.col("_total")).alias("total"))
        level, left = stored(level, "links", False), now
        ended.append(level.where("up IS NULL"))
        open_ = level.where("up IS NOT NULL")
        links.append(open_)
    if now:
        circles = stored(open_.select("id"), "circles")
        links = [link.join(circles, "id", "left_anti") for link in links]
        ended.append(base.join(circles, "id", "left_semi").select("id", F.lit(None).cast(base.schema["up"].dataType).alias("up"), F.lit(0).cast("long").alias("hops"), "total"))
        # Replies to a message of a circle are cut off from it, so every message is on a path of its own.
    return links, reduce(DataFrame.unionByName, ended).select("id", "hops", "total")


def branches(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = "score", best: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, mask): the `best` branches of each tree, each as one conversation.

    A branch is the path from a root to a message without replies; its score is the sum of its messages' scores (null:
    0), and the highest rank first, ties by the leaf's id. A message without a parent, or whose parent isn't in its
    tree or is itself, is a root; a tree may have several. Null trees are one tree, and ids may be null. Of rows alike
    in tree and id, which name one message, the least by parent, role and text counts. Other columns play no part, and
    an empty table gives no rows.

    Ancestors are found by links that double, narrow rows joined by message and never by tree, so a tree of any size is
    dealt out; the paths of the chosen leaves come from the same links, longest first, each message of a path once.
    Texts meet their paths last. Best branches are chosen among the best of shares of a tree.
    """
    value = F.col(score).cast("double") if score else F.lit(0.0)
    rows = messages.select(F.struct(F.col(tree).alias("tree"), F.col(node).alias("node")).alias("id"), F.struct(F.col(parent).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.coalesce(value, F.lit(0.0)).alias("score")).alias("m"))
    rows = stored(rows.groupBy("id").agg(F.min("m").alias("m")).select("id", F.when(F.col("m.parent").isNotNull(), F.struct("id.tree", F.col("m.parent").alias("node"))).alias("up"), "m.role", "m.text", "m.score"), "messages")
    there = rows.select(F.col("id").alias("_there"))
    nodes = stored(rows.select("id", "up", "score").join(there, F.col("up") == F.col("_there"), "left").select("id", F.when(F.col("_there") != F.col("id"), F.col("_there")).alias("up"), "score"), "nodes")
    links, roots = ancestors(nodes)
    answered = links[0].select(F.col("up").alias("_up")).distinct()
    leaves = roots.join(answered, F.col("id") == F.col("_up"), "left_anti")
    order = [F.desc("total"), "id"]
    share = F.row_number().over(Window.partitionBy("id.tree", F.pmod(F.xxhash64("id.node"), F.lit(SHARES))).orderBy(*order))
    leaves = leaves.withColumn("rank", share).where(F.col("rank") <= best)
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("id.tree").orderBy(*order))).where(F.col("rank") <= best)
    chosen = stored(leaves.select(F.col("id").alias("leaf"), "rank", "hops", "total"), "branches")
    paths = [chosen.select("leaf", F.col("leaf").alias("at"), F.col("hops").alias("place"))]
    for k in reversed(range(len(links))):
        reached = reduce(DataFrame.unionByName, paths).join(links[k].select("id", "up"), F.col("at") == F.col("id"))
        paths.append(stored(reached.select("leaf", F.col("up").alias("at"), (F.col("place") - F.lit(1 << k)).alias("place")), "paths", False))
    turns = reduce(DataFrame.unionByName, paths).join(rows.select("id", "role", "text"), F.col("at") == F.col("id")).select("leaf", "place", "role", "text")
    out = formatted(turns, ["leaf"]).join(chosen.select(F.col("leaf").alias("_leaf"), "rank", "total"), F.col("leaf") == F.col("_leaf"))
    return out.select(F.col("leaf.tree").alias(tree), F.col("leaf.node").alias("leaf"), "rank", F.col("total").alias("score"), "n_turns", "formatted", "mask")


def chains(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of conversations as messages (tree, node, parent, role, text): each answers the row before it by turn.

    Rows alike in turn follow by role and text; repeated rows are turns of their own. A conversation of any length is
    numbered in ranges.
    """
    rows = conversations.select(F.col(key).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = numbered(rows, ["tree"], ["turn", "role", "text"], "node", most=0)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and one whose texts are control strings; everything is read back from the output."""
    said = f"{CLOSE}{HEAD} ok {BODY}"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(said).alias("text"))
    output = stored(branches(chains(rows.unionByName(odd)), score=None), "chat")
    read = turns_of(output, ["tree", "leaf"])
    turns = read.groupBy("tree", "leaf").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), F.coalesce("learnt", F.lit("")).alias("learnt")))).alias("t"))
    said, learnt = F.array_join(F.transform("t", lambda x: x["said"]), ""), F.array_join(F.transform("t", lambda x: x["learnt"]), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    sizes = output.select(F.col("tree").alias("_tree"), F.length("formatted").cast("long").alias("formatted_chars"))
    met = turns.join(sizes, F.col("tree").eqNullSafe(F.col("_tree")))
    return met.select(F.col("tree").alias("conv_id"), "n_turns", digest(said).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), digest(learnt).alias("loss_sha256"), "formatted_chars")


#: DuckDB SQL for op12_chat: the turns' own texts; control strings, which the escaped text has one character more for, are counted.
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE '{LEARNT}' END, '{CLOSE}{HEAD} ok {BODY}', CASE i WHEN 0 THEN 'user' ELSE '{LEARNT}' END, '{CLOSE}{HEAD} ok {BODY}' FROM (SELECT unnest(range(2)) AS i)),
e AS (SELECT *, len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
  sum({len(OPEN + HEAD + BODY + CLOSE)} + length(role) + length(text) + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
