"""Quality rules: base rules over document statistics, and gradient-boosted trees trained on labelled rows.

The trees are trained here, flattened into numpy node arrays and scored level by level for a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.tables import cut, numbered
from quillspark.llm.common import map_texts, narrowed, small

#: Statistics that the contract names, then the model's features; +1: the chance of good text may only rise with it, -1: only fall.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "mark_share": 0, "bar_share": -1, "bang_share": -1, "distinct_share": 0, "stay_share": -1, "line_words": 0, "comma_share": 0}
#: Bins of a feature, trees, trees after which the rows' scores are written down, rows of a block, bits of the sums' fractions.
BINS, TREES, NOTED, BLOCK, UNIT = 64, 60, 15, 1 << 16, 32
#: Share of good labelled rows that the verdict must keep.
RECALL = 0.995
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside any window of `width` words that occurs twice or more.

    Windows are compared exactly: words are numbered, and ranks of doubled windows are made from ranks of halves.
    """
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == len(words):
        return 0
    span = 1
    while span < width:
        step = min(span, width - span)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        values, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        span += step
        if len(values) == len(ranks):
            return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[ranks] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES of a whole text; all 0 for one without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(kinds[:128].sum() + kinds[192:].sum())
    n, letters = len(words), points - int(kinds[SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    symbols = int(kinds[SYMBOLS].sum())
    stay = sum(map(bytes.__eq__, words, words[1:]))
    share = lambda x, of: float(x) / of if of else 0.0
    return [n, letters, symbols, dup_lines, repeats], [
        float(np.log1p(n)), share(letters, n), share(symbols, letters), share(dup_lines, len(lines)), share(repeats, n),
        share(kinds[65:91].sum(), letters), share(kinds[48:58].sum(), letters), share(kinds[33:48].sum() + kinds[58:65].sum(), letters),
        share(kinds[124], n), share(kinds[33], n), share(len(set(words)), n), share(stay, n), share(n, len(lines)), share(kinds[44], n),
    ]


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The base rules: under 20 words, or over 30 of 100 words in repeated windows."""
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


@dataclass
class Trees:
    """Flattened trees: node arrays of all trees, roots' places, and the threshold of the verdict."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int
    threshold: float = 0.5

    def leaves(self, x: np.ndarray, tree: int = 0) -> np.ndarray:
        """The node where each row of features ends in a tree."""
        at, rows = np.full(len(x), self.roots[tree]), np.arange(len(x))
        for _ in range(self.depth):
            inner = self.left[at] >= 0
            goes = x[rows, self.feature[at]] <= self.cut[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
        return at

    def raw(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """The log odds of good text for each row of features; with `first`, what the trees from that one on add."""
        total = np.full(len(x), 0.0 if first else self.bias)
        for tree in range(first, len(self.roots)):
            total += self.value[self.leaves(x, tree)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of good text for each row of features."""
        return 1 / (1 + np.exp(-self.raw(x)))


def grown(edges: list[np.ndarray], base: float, signs: list[int], histograms: Callable, trees: int, depth: int = 4, rate: float = 0.2, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss on binned features, with monotonic constraints by feature sign.

    `histograms(model, tree, open)` gives, for the model so far and the tree begun, the sums (node, feature, bin,
    [count, gradient, curvature]) of the rows at each open node of a level; rows are seen nowhere else. A
    split on a signed feature must order its children's values by the sign, and its children inherit the midpoint as a
    bound, so whole trees are monotone.
    """
    nodes: list[list[float]] = []
    roots: list[int] = []
    bias = float(np.log(base / (1 - base)))
    for _ in range(trees):
        model = _arrays(nodes, roots, bias, depth)
        roots.append(len(nodes))
        nodes.append([0, 0.0, -1, -1, 0.0])
        open_nodes = [(len(nodes) - 1, -np.inf, np.inf)]
        for level in range(depth + 1):
            sums = histograms(model, _arrays(nodes, roots[-1:], 0.0, depth), [me for me, _, _ in open_nodes])
            below = []
            for (me, low, high), of in zip(open_nodes, sums, strict=True):
                n, sum_g, sum_h = of[0].sum(axis=0)
                nodes[me][4] = rate * float(np.clip(-sum_g / (sum_h + ridge), low, high))
                best = (1e-6, None)
                for j, e in enumerate(edges if level < depth and n >= 2 * least else []):
                    if not len(e):
                        continue
                    n_l, g_l, h_l = np.cumsum(of[j], axis=0)[: len(e)].T
                    v_l = np.clip(-g_l / (h_l + ridge), low, high)
                    v_r = np.clip(-(sum_g - g_l) / (sum_h - h_l + ridge), low, high)
                    gain = g_l**2 / (h_l + ridge) + (sum_g - g_l) ** 2 / (sum_h - h_l + ridge) - sum_g**2 / (sum_h + ridge)
                    fine = (n_l >= least) & (n - n_l >= least) & (signs[j] * (v_r - v_l) >= 0)
                    gain = np.where(fine, gain, -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, k, float(v_l[k] + v_r[k]) / 2))
                if best[1]:
                    j, k, middle = best[1]
                    bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
                    nodes[me][:4] = [j, float(edges[j][k]), len(nodes), len(nodes) + 1]
                    for low_high in bounds:
                        below.append((len(nodes), *low_high))
                        nodes.append([0, 0.0, -1, -1, 0.0])
            open_nodes = below
            if not open_nodes:
                break
    return _arrays(nodes, roots, bias, depth)


def sums_of(x: np.ndarray, y: np.ndarray, score: np.ndarray, binned: np.ndarray, tree: Trees, at_nodes: list[int], bins: int) -> np.ndarray:
    """The sums that `grown` asks for, over some rows, in whole numbers of 2**-UNIT: they add up alike in any order."""
    p = 1 / (1 + np.exp(-score))
    what = np.round(np.stack([np.ones(len(y)), p - y, np.maximum(p * (1 - p), 1e-9)]) * 2.0**UNIT).astype(np.int64)
    at = tree.leaves(x)
    out = np.zeros((len(at_nodes), binned.shape[1], bins, 3), np.int64)
    for i, me in enumerate(at_nodes):
        rows = np.flatnonzero(at == me)
        for j in range(binned.shape[1]):
            for k in range(3):
                np.add.at(out[i, j, :, k], binned[rows, j], what[k, rows])
    return out


def cuts(values: Callable[[int, list[int]], dict[int, float]], n: int, features: int, bins: int) -> list[np.ndarray]:
    """Quantiles of each feature, as numpy interpolates them, from the values of given 0-based ranks."""
    places = np.linspace(0, 1, bins + 1)[1:-1] * (n - 1)
    low, high = np.floor(places).astype(int), np.ceil(places).astype(int)
    out = []
    for j in range(features):
        of = values(j, sorted({*low.tolist(), *high.tolist()}))
        a, b = np.array([of[i] for i in low.tolist()]), np.array([of[i] for i in high.tolist()])
        out.append(np.unique(a + (b - a) * (places - low)))
    return out


def binned_by(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, bins: int = BINS) -> Trees:
    """`grown` on rows in memory. Without rows, or with one label only, the model is a constant."""
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(np.unique(y)) < 2:
        return grown([], base, signs, lambda *a: [], 0)
    ordered = np.sort(x, axis=0)
    edges = cuts(lambda j, ranks: {r: float(ordered[r, j]) for r in ranks}, len(y), len(signs), bins)
    binned = binned_by(edges, x)
    return grown(edges, base, signs, lambda model, tree, at: sums_of(x, y, model.raw(x), binned, tree, at, bins) / 2.0**UNIT, trees)


def _arrays(nodes: list[list[float]], roots: list[int], bias: float, depth: int) -> Trees:
    a = np.array(nodes or [[0, 0, -1, -1, 0]], dtype=np.float64)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), bias, depth)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str = "quality", most: int | None = None) -> DataFrame:
    """(doc_id, text, y) of all labelled rows; copies of a key count once, with the least label.

    With `most`, only so many keys are taken, those with the least hashes.
    """
    keys = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    if most is not None:
        keys = keys.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
    return narrowed(docs, doc_id=key, text=text).join(small(keys, 64), "doc_id").select("doc_id", "text", "y")


def _stats(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t) for t in texts]
    return np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS)), np.array([b[1] for b in both], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> Trees:
    """A model from all labelled rows: their statistics stay in blocks of Spark's, only sums by bins reach the driver.

    A quarter of the rows, by hash, is kept from the trees; the threshold is the score that keeps `recall` of its good
    rows, and never above 0.5. Ranks are exact, and sums are of whole numbers, so the model is the same on any run.
    """
    side = F.pmod(F.xxhash64("doc_id", F.lit("side")), F.lit(4)).alias("side")

    def run(ids: list, texts: list) -> dict:
        counts, x = _stats(texts)
        return {"y": [i["y"] for i in ids], "held": [i["side"] == 0 for i in ids], "x": list(x), "base": base_failed(counts)}

    found = cut(map_texts(labelled(docs, labels, key, text).select(F.struct("y", side).alias("id"), "text"), run, "y int, held boolean, x array<double>, base boolean", keys="id").where("NOT base").drop("base"))
    learned, held = found.where("NOT held"), found.where("held AND y = 1")
    n, good, bad = learned.agg(F.count("*"), F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)).first()
    base = float(np.clip(good / n if n else 0.5, 1e-3, 1 - 1e-3))
    model = _boosted(learned, n, base) if good and bad else grown([], base, [], lambda *a: [], 0)
    n_held = held.count()
    if not n_held:
        model.threshold = 0.0
        return model

    def scored(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(model.score(_rows(batch.column("x"))))], ["score"])

    ranked = numbered(cut(held.select("x").mapInArrow(scored, "score double")).select(F.lit(0).alias("g"), "score"), ["g"], ["score"])
    model.threshold = min(0.5, float(ranked.where(F.col("number") == int((1 - recall) * n_held) + 1).first()["score"]))
    return model


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _boosted(learned: DataFrame, n: int, base: float) -> Trees:
    """Trees from rows (y, x) in blocks: a job for each level of a tree adds up the blocks' sums."""
    width = len(FEATURES)
    ranked = numbered(learned.select(F.posexplode("x").alias("j", "value")), ["j"], ["value"])
    places = np.linspace(0, 1, BINS + 1)[1:-1] * (n - 1)
    wanted = sorted({int(f(p)) for p in places for f in (np.floor, np.ceil)})
    at = {(r["j"], r["number"] - 1): r["value"] for r in ranked.where(F.col("number").isin([w + 1 for w in wanted])).collect()}
    edges = cuts(lambda j, ranks: {r: at[j, r] for r in ranks}, n, width, BINS)

    def blocks(batches):
        for batch in batches:
            x, y = _rows(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()), pa.array([binned_by(edges, x).tobytes()], pa.binary()), pa.array([(y == 1).tobytes()], pa.binary()), pa.array([np.zeros(len(y)).tobytes()], pa.binary())], ["x", "b", "y", "s"])

    def unpacked(row):
        x = np.frombuffer(row["x"]).reshape(-1, width)
        return x, np.frombuffer(row["b"], np.uint8).reshape(-1, width), np.frombuffer(row["y"], bool).astype(float), np.frombuffer(row["s"])

    table = cut(learned.select("x", "y").coalesce(-(-n // BLOCK)).mapInArrow(blocks, "x binary, b binary, y binary, s binary"))
    noted = 0

    def histograms(model: Trees, tree: Trees, at_nodes: list[int]) -> np.ndarray:
        nonlocal table, noted
        since = noted
        if len(model.roots) >= since + NOTED:

            def moved(batches):
                for batch in batches:
                    out = []
                    for row in batch.to_pylist():
                        x, _, _, s = unpacked(row)
                        out.append({**row, "s": (s + model.raw(x, since)).tobytes()})
                    yield pa.RecordBatch.from_pylist(out, batch.schema)

            table, noted = cut(table.mapInArrow(moved, table.schema)), len(model.roots)
            since = noted

        def summed(batches):
            total = np.zeros((len(at_nodes), width, BINS, 3), np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    x, b, y, s = unpacked(row)
                    total += sums_of(x, y, s + model.raw(x, since), b, tree, at_nodes, BINS)
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

        shape = (len(at_nodes), width, BINS, 3)
        return sum(np.frombuffer(r["sums"], np.int64).reshape(shape) for r in table.mapInArrow(summed, "sums binary").collect()) / 2.0**UNIT

    return grown(edges, base, list(FEATURES.values()), histograms, TREES)


def judge(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for every row.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one: order, ties, repeats and
    other columns play no part, and null keys are carried along. An empty table gives no rows.
    """

    def run(ids: list, texts: list) -> dict:
        counts, x = _stats(texts)
        failed, score = base_failed(counts), model.score(x)
        return {"doc_id": ids, "base_failed": failed, "kept": ~failed & (score >= model.threshold), "score": score} | {c: counts[:, i] for i, c in enumerate(COUNTS)}

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(narrowed(docs, doc_id=key, text=text), run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that pass the base rules and the trees' verdict.

    Null, empty and wordless texts fail the base rules and go, whatever their other columns hold. Rows are judged one
    by one, so repeats and ties stay or go together; an empty table gives no rows.
    """
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            counts, x = _stats([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(~base_failed(counts) & (model.score(x) >= model.threshold)))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the trees' verdict for all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, train(docs, labels))
