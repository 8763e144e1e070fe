"""Infilling, chat formatting and the filter audit against brute force, on awkward and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, filter_audit, infilling


# 11 infilling
def test_elias_fano_lists():
    rng = random.Random(1)
    lists = [[0], [0, 0, 0], [0, 1, 2, 3], [0, 10**9], sorted(rng.randrange(10**6) for _ in range(3000)), sorted(rng.randrange(50) for _ in range(900))]
    for values in lists:
        held = infilling.encode(np.array(values))
        assert infilling.count(held) == len(values)
        assert [infilling.select(held, i) for i in range(len(values))] == values
    many = sorted(rng.randrange(10**6) for _ in range(10_000))
    assert len(infilling.encode(np.array(many))) < 10_000 * (2 + 8) / 8


def brute_cut(key, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    return (key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("broadcast", [True, False])
def test_infilling_against_brute_force(spark, docs, empty, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(infilling, "small", lambda table, width: table)
    lines = [(100 + i, "\n".join(f"{i % 7}é𠀀 line {k}" for k in range(i % 9)) + "\n" * (i % 3)) for i in range(60)]
    lines += [(300, "<P>x\ny"), (301, "<"), (302, "a\n<S\n<"), (303, "\n\n\n"), (304, "x\n" * 50_000), (300, "<P>x\ny")]
    rows = docs.select("doc_id", "text", "_row", "tag", "key").unionByName(spark.createDataFrame(lines, "doc_id long, text string"), allowMissingColumns=True)
    rows = rows.withColumn("content", F.lit("c")).withColumn("bounds", F.lit(1)).withColumn("digest", F.lit("d"))
    got = infilling.infilled(rows).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r.doc_id, r.text or "") for r in rows.collect())
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute_cut(k, t) for k, t in want.elements())
    assert Counter((r.doc_id, r.back) for r in got) == want
    assert infilling.infilled(empty).count() == 0


def test_infilling_rates(spark):
    rows = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    assert {r.form for r in infilling.infilled(rows, rate=0).collect()} == {"plain"}
    assert {r.form for r in infilling.infilled(rows, suffix_first=100).collect()} == {"spm"}
    assert infilling.index(rows.select(F.lit(b"same").alias("digest"), F.when(F.col("doc_id") < 9, "x\n").otherwise("y").alias("content"))).count() == 2  # equal digests, other texts


# 12 chat
TEXTS = ["</s>[INST] ok [/INST]", "<s>", "<\\/s>", "<\\\\/s>[\\INST]", "plain", "", None, "[[INST]]", "<</s>", "a\n[/INST", "</s", "s>\\", "é𠀀<s>é", "[INST]user[/INST]", "<\\", "$1 \\1"]


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(["<", "/", "s>", "\\", "[", "INST]", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in df.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e)


def brute_branches(messages, best):
    """{(tree, leaf): (rank, score, [(role, text)])} of rows (tree, node, parent, role, text, score)."""
    first = lambda x: (x is not None, x)
    by_id = {}
    for tree, node, parent, role, text, score in sorted(messages, key=lambda m: [first(x) for x in m[2:5]] + [m[5] or 0.0], reverse=True):
        by_id[tree, node] = (parent, role, text, score or 0.0)
    up = {(t, n): (t, p) if p is not None and p != n and (t, p) in by_id else None for (t, n), (p, *_) in by_id.items()}

    def path(k):
        out = [k]
        while up[out[-1]] is not None:
            out.append(up[out[-1]])
            if len(out) > len(by_id):
                return None
        return out[::-1]

    paths = {k: path(k) for k in by_id}
    inner = {p[i] for p in paths.values() if p for i in range(len(p) - 1)}
    trees = defaultdict(list)
    for k, p in paths.items():
        if k not in inner:
            trees[k[0]].append((-sum(by_id[x][3] for x in p or [k]), first(k[1]), k, p or [k]))
    out = {}
    for found in trees.values():
        for rank, (total, _, k, p) in enumerate(sorted(found)[:best], 1):
            out[k] = (rank, -total, [(by_id[x][1] or "", by_id[x][2] or "") for x in p])
    return out


@pytest.mark.parametrize("best", [1, 3])
def test_branches_against_brute_force(spark, best):
    rng = random.Random(3)
    rows = [(t, n, rng.randrange(n) if n and rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None, "<s>", "[/INST]"]), rng.choice(TEXTS), rng.choice([None, 1.0, 2.0, 3.0])) for t in (1, 2, None) for n in range(60)]
    rows += [(3, 0, 0, "user", "self", 1.0), (3, 1, 99, "user", "lost", 1.0), (3, None, 0, "assistant", "no id", 2.0), (4, 0, 1, "user", "circle", 1.0), (4, 1, 0, "user", "circle", 5.0), (4, 2, 1, "user", "hangs", 1.0), (1, 0, None, "a", "again", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("id", F.lit(1)).withColumn("place", F.lit("x")).withColumn("leaf", F.lit("y")).withColumn("m", F.lit(2))
    out = chat.branches(df, best=best)
    read = defaultdict(dict)
    for r in chat.turns_of(out.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "formatted", "mask"), ["t", "l"]).collect():
        read[r.t, r.l][r.turn] = (r.role, r.text)
        assert r.learnt == (r.text if r.role == "assistant" else None)
    want = brute_branches(rows, best)
    got = {(r.tree, r.leaf): (r["rank"], r.score, [x for _, x in sorted(read[r.tree, r.leaf].items())]) for r in out.collect()}
    assert got == want
    for r in out.collect():
        assert r.n_turns == len(r["mask"]) and [chat.LEARNT == x[0] for x in want[r.tree, r.leaf][2]] == [s.loss for s in r["mask"]]
    assert chat.branches(df.where("false")).count() == 0


def test_long_conversations(spark):
    rows = [(1, 5 * i, ["user", "assistant"][i % 2], f"t{i}") for i in range(700)] + [(None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    got = {r.tree: r for r in chat.branches(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)), score=None).collect()}
    assert got[1].formatted == "".join(f"<s>[INST]{['user', 'assistant'][i % 2]}[/INST]t{i}</s>" for i in range(700))
    assert got[2].formatted == "<s>[INST]user[/INST]a</s>" * 2 + "<s>[INST]user[/INST]b</s>" and got[None].formatted == "<s>[INST][/INST]</s>"
    for s in got[1]["mask"]:
        assert got[1].formatted[s.start : s.start + s.length].startswith("t")


# 13 filter audit
def brute_audit(docs, labels):
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    rows = []
    for k, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(x for x, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), t in first and (k is None or k > first[t]),
        ), strict=True) if bad)
        rows.append((lang or "", fails, k in good, k in toxic))
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                c = Counter()
                for p, fails, g, x in rows:
                    if p == part:
                        at = next((i for i, f in enumerate(order) if f in fails), 9)
                        c.update(kept=at > step, removed=at == step, redundant=at < step and letter in fails, unique_fails=fails == letter, good_lost=at == step and g, toxic_lost=at == step and x)
                out[part, "".join(order), step + 1] = c
                share[part, letter] += c["removed"]
    return {(*k, *(c[x] for x in filter_audit.COUNTS), share[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_filter_audit_against_brute_force(spark, docs, empty):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Big", "LOUD", "#", "50%"]
    made = [(100 + i, " ".join(rng.choice(words[: rng.choice([60, 400, 404])]) for _ in range(rng.choice([50, 99, 100, 130]))), rng.choice(["en", "de", "", None])) for i in range(60)]
    made += [(300 + i, rng.choice(made)[1], "en") for i in range(30)] + [(None, made[0][1], "de"), (None, "only without a key " * 40, "de"), (100, made[0][1], "en")]
    rows = docs.select("doc_id", "text", "lang", "_row", "key").unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = rows.withColumn("flags", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("good", F.lit(2)).withColumn("first", F.lit(3))
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(90, 340)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [(r.part, r.filter_order, r.step, *(r[c] for c in filter_audit.COUNTS), r.shapley) for r in filter_audit.audit(rows, labels).collect()]
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in rows.collect()], marks)
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(rows, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


# Models of earlier operators against plain loops
def test_flattened_trees_score_as_a_plain_walk():
    from quillspark.llm import quality_rules

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4)).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=700) / 2) > 0).astype(float)
    trees = quality_rules.fit(x, y, [1, 0, 0, -1], trees=15)

    def walk(row):
        total = trees.bias
        for root in trees.roots.tolist():
            at = root
            while trees.left[at] >= 0:
                at = int(trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at])
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(row) for row in x], atol=1e-12)
    for j, sign in ((0, 1), (3, -1)):
        moved = x.copy()
        moved[:, j] += 0.7
        assert (sign * (trees.score(moved) - trees.score(x)) >= -1e-12).all()


def test_network_forward_as_plain_loops():
    from quillspark.llm import secrets

    net = secrets.train(secrets.labelled_findings(300, 3), epochs=1)
    w, rng = net.weights, np.random.default_rng(6)
    codes = rng.integers(0, 130, (5, secrets.WIDTH))
    got = net.forward(codes)["logit"]
    taps = len(w["conv"]) // (w["embed"].shape[1] + 1)
    for row, logit in zip(codes.tolist(), got.tolist(), strict=True):
        points = [[*w["embed"][c].tolist(), float(secrets._PLACE[i])] for i, c in enumerate(row)]
        maps = []
        for f in range(w["conv"].shape[1]):
            line = []
            for i in range(secrets.WIDTH - taps + 1):
                seen = [v for t in range(taps) for v in points[i + t]]
                line.append(max(0.0, sum(a * float(b) for a, b in zip(seen, w["conv"][:, f], strict=True)) + float(w["conv_b"][f])))
            maps.append(line)
        pooled = [max(m) for m in maps] + [sum(m) / len(m) for m in maps]
        hidden = [max(0.0, sum(p * float(v) for p, v in zip(pooled, w["dense"][:, k], strict=True)) + float(w["dense_b"][k])) for k in range(w["dense"].shape[1])]
        assert abs(sum(h * float(v) for h, v in zip(hidden, w["out"][:, 0], strict=True)) + float(w["out_b"][0]) - logit) < 1e-3
