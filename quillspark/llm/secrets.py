"""Secret scans: base patterns, and a character convolutional network over every other candidate and its context."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import map_texts, narrowed

#: The base patterns; letters of assign in either case, within ASCII.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A candidate: a run of these characters, LEAST at least; marks at its ends are left off.
CHARS, EDGES, LEAST = r"A-Za-z0-9+/_.=:@#$%&*!?^~-", ".:!?-", 16
CANDIDATE = re.compile(f"[{CHARS}]{{{LEAST},}}")
KINDS = ["assign", "access", "hex", "model"]
#: Characters of a window of a candidate, before it and after it; windows of long candidates lie STEP apart.
BEFORE, WITHIN, AFTER, STEP = 20, 40, 8, 20
WIDTH = BEFORE + WITHIN + AFTER
#: Share of labelled secrets that the threshold must find.
RECALL = 0.97
_HEX_MAP = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_CANDIDATE_MAP = bytes(1 if b < 128 and re.match(f"[{CHARS}]", chr(b)) else 0 for b in range(256))
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, per kind leftmost and non-overlapping; too short matches are dropped.

    Cheap tests of the bytes come first: the patterns run only over texts that can hold a match.
    """
    raw = text.encode("utf-8", "surrogatepass")
    out = []
    if _WORDS.search(raw.lower()):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"\x01" * 16 in raw.translate(_HEX_MAP):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of candidate characters, without the parts that base spans cover and without marks at their ends."""
    if b"\x01" * LEAST not in text.encode("utf-8", "surrogatepass").translate(_CANDIDATE_MAP):
        return
    spans = sorted((a, b) for _, a, b in taken)
    for m in CANDIDATE.finditer(text):
        at, cuts = m.start(), [(a, b) for a, b in spans if a < m.end() and m.start() < b]
        for low, high in [*cuts, (m.end(), m.end())]:
            start, end = at, max(at, low)
            while end > start and text[end - 1] in EDGES:
                end -= 1
            while start < end and text[start] in EDGES:
                start += 1
            if end - start >= LEAST:
                yield start, end
            at = max(at, high)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of a candidate: all of it, or overlapping parts that together cover the whole."""
    if end - start <= WITHIN:
        return [(start, end)]
    return [(a, a + WITHIN) for a in [*range(start, end - WITHIN, STEP), end - WITHIN]]


def _codes(text: str, start: int, end: int) -> np.ndarray:
    """Character codes around a window: 0 nothing, 1 + ASCII, 129 any other."""
    before, inside, after = text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]
    line = before.rjust(BEFORE, "\0") + inside.ljust(WITHIN, "\0") + after.ljust(AFTER, "\0")
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points == 0, 0, np.where(points < 128, points + 1, 129)).astype(np.int16)


@dataclass
class Network:
    """Embedding, one convolution with the largest and mean response of each filter, a hidden layer, a logit."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        e = np.concatenate([w["embed"][codes], np.broadcast_to(_PLACE[None, :, None], (len(codes), WIDTH, 1))], axis=2)
        taps = len(w["conv"]) // e.shape[2]
        steps = WIDTH - taps + 1
        cols = np.concatenate([e[:, i : i + steps] for i in range(taps)], axis=2)
        z = cols @ w["conv"] + w["conv_b"]
        r = np.maximum(z, 0)
        pooled = np.concatenate([r.max(axis=1), r.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return {"cols": cols, "z": z, "r": r, "pooled": pooled, "hidden": hidden, "logit": (hidden @ w["out"] + w["out_b"])[:, 0]}

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated chances that candidates are secrets."""
        if not len(codes):
            return np.zeros(0)
        logit = np.concatenate([self.forward(codes[i : i + 512])["logit"] for i in range(0, len(codes), 512)])
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))

    def candidate_scores(self, text: str, found: list[tuple[int, int]]) -> list[float]:
        """The greatest score of each candidate's windows."""
        cut = [windows(a, b) for a, b in found]
        score = self.scores(np.array([_codes(text, a, b) for w in cut for a, b in w], np.int16).reshape(-1, WIDTH))
        ends = np.cumsum([0, *map(len, cut)])
        return [float(score[a:b].max()) for a, b in zip(ends, ends[1:], strict=False)]


_PLACE = np.r_[np.zeros(BEFORE), np.ones(WITHIN), np.zeros(AFTER)].astype(np.float32)


def _start(seed: int, dims: int = 6, taps: int = 5, filters: int = 20, hidden: int = 16) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"embed": (130, dims), "conv": (taps * (dims + 1), filters), "conv_b": (filters,), "dense": (2 * filters, hidden), "dense_b": (hidden,), "out": (hidden, 1), "out_b": (1,)}
    return {k: (rng.normal(0, (2 / s[0]) ** 0.5 if k != "embed" else 0.5, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}


def _gradients(net: Network, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w, f = net.weights, net.forward(codes)
    n, filters = len(y), w["conv"].shape[1]
    d = ((1 / (1 + np.exp(-f["logit"])) - y) / n).astype(np.float32)[:, None]
    g = {"out": f["hidden"].T @ d, "out_b": d.sum(0)}
    dh = (d @ w["out"].T) * (f["hidden"] > 0)
    g |= {"dense": f["pooled"].T @ dh, "dense_b": dh.sum(0)}
    dp = dh @ w["dense"].T
    dr = np.repeat(dp[:, None, filters:] / f["r"].shape[1], f["r"].shape[1], axis=1)
    best = f["r"].argmax(axis=1)
    dr[np.arange(n)[:, None], best, np.arange(filters)[None]] += dp[:, :filters]
    dz = dr * (f["z"] > 0)
    flat = dz.reshape(-1, filters)
    g |= {"conv": f["cols"].reshape(len(flat), -1).T @ flat, "conv_b": flat.sum(0)}
    dcols = (flat @ w["conv"].T).reshape(n, dz.shape[1], -1)
    size = w["embed"].shape[1] + 1
    de = np.zeros((n, WIDTH, size), np.float32)
    for i in range(dcols.shape[2] // size):
        de[:, i : i + dz.shape[1]] += dcols[:, :, i * size : (i + 1) * size]
    g["embed"] = np.stack([np.bincount(codes.ravel(), de[:, :, k].ravel(), minlength=130) for k in range(size - 1)], axis=1).astype(np.float32)
    return g


#: The forms of generated secrets, for a test to leave some out of training.
FORMS = ["prefixed", "dotted", "base64", "hex", "key", "mixed", "password", "link"]


def labelled_findings(n: int, seed: int, forms: list[str] | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): n generated findings, secrets of the forms and look-alikes, half of each, in contexts.

    Look-alikes are long words, links, host names, identifiers, version strings, separators, numbers and dates.
    """
    r = random.Random(seed)
    syllables = "an be ch de en er ei ge heit ing keit lich ment on or pf qu re sch st th ti tion tre ung ver wh zu ou ea ca ja lo mi".split()
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    host = lambda: r.choice(["", "www.", "api."]) + word(2) + "." + r.choice(["org", "com", "net", "example.com"])
    path = lambda: "/" + "/".join(word(r.randint(1, 3)) for _ in range(r.randint(1, 4)))
    bare = lambda k: base64.urlsafe_b64encode(r.randbytes(k)).decode().rstrip("=")

    def secret() -> tuple[str, str, str]:
        """What stands before, the secret, and what follows it within the same run of characters."""
        form = r.choice(forms or FORMS)
        lead = r.choice(["", word(3) + " ", "key: ", "auth ", "Bearer ", "export X_KEY=", "credential ", "pwd=", 'private "', word(2) + ", "])
        if form == "prefixed":
            return lead, r.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "rk_live_", "npm_", "hf_"]) + pick(mixed, r.randint(20, 40)), ""
        if form == "dotted":
            return lead, ".".join(bare(k) for k in (r.randint(12, 24), r.randint(20, 60), 32)), ""
        if form == "base64":
            return lead, base64.b64encode(r.randbytes(r.randint(15, 48))).decode(), ""
        if form == "hex":
            return lead, pick(digits + "ABCDEF", r.choice([32, 40, 64])), ""
        if form == "key":
            return lead, "AIza" + pick(mixed + "_-", 35), ""
        if form == "mixed":
            return lead, pick(mixed + r.choice(["", "_-", "+/"]), r.randint(20, 48)), ""
        if form == "password":
            return r.choice([lead, "pass phrase: ", "login "]), pick(mixed + "!#$%&@*^~?" * 2, r.randint(16, 32)).strip(EDGES), ""
        return lead + r.choice(["", "https:"]) + "//" + host() + path() + r.choice(["/", "?k="]), pick(mixed, r.randint(20, 40)), r.choice(["", path(), "/callback"])

    def plain() -> tuple[str, str]:
        kind = r.randrange(16)
        lead = " ".join(word(r.randint(1, 3)) for _ in range(3)) + " "
        if kind < 3:
            text = word(r.randint(6, 12))
            return lead, r.choice([text, text.capitalize(), text.upper()])
        if kind in (3, 4):
            asked = "?" + "&".join(f"{word(1)}={r.choice([word(2), pick(digits, 3)])}" for _ in range(r.randint(1, 2)))
            return lead, r.choice(["http://", "https://"]) + host() + path() + r.choice(["", "/", ".html", "#" + word(2), asked])
        if kind == 5:
            return lead, word(2) + r.choice([".", "_", ""]) + word(1) + "@" + r.choice(["mail", "smtp", "www"]) + str(r.randint(1, 99)) + "." + host()
        if kind == 6:
            return lead, r.choice("_#:").join(word(r.randint(1, 3)) for _ in range(r.randint(3, 5)))
        if kind == 7:
            return lead, "".join(word(2).capitalize() for _ in range(r.randint(3, 6)))
        if kind == 8:
            return lead, r.choice("=-_.+*#~!?") * r.randint(16, 60)
        if kind == 9:
            stamp = f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"
            numbers = [pick(digits, r.randint(16, 24)), "-".join(pick(digits, 4) for _ in range(r.randint(4, 6))), stamp + "-" + pick(digits, 6), stamp + "T0" + pick(digits, 1) + ":1" + pick(digits, 1) + ":00"]
            return lead, r.choice(numbers)
        if kind == 10:
            return lead, "-".join(word(r.randint(1, 3)) for _ in range(r.randint(3, 6)))
        if kind == 11:
            return lead, "/".join(word(r.randint(1, 3)) for _ in range(r.randint(3, 6))) + r.choice(["", ".txt", ".py"])
        if kind == 12:
            return lead, word(r.randint(2, 4)) + r.choice(["...", "--", "!!", "=", "::"]) + word(r.randint(3, 5))
        if kind == 13:
            return lead, "$" + ".".join([pick(digits, 3)] * r.randint(3, 4)) + "-$" + pick(digits, 5) + "/" + word(2)
        if kind == 14:
            return lead, word(r.randint(4, 9)) + r.choice([".", "", "!"]) + r.choice("*&%$#!=~_") * r.randint(2, 4)
        return lead, ".".join(word(r.randint(1, 4)) for _ in range(r.randint(3, 6)))

    out = []
    while len(out) < n:
        label = len(out) % 2
        lead, body, tail = secret() if label else (*plain(), "")
        body = body.strip(EDGES) if label else body
        before = " ".join(word(r.randint(1, 4)) for _ in range(r.randint(0, 4))) + " " + lead
        if len(body) >= LEAST:
            text = before + body + tail + r.choice(["", " ", ".", '"', ", ", "\n"])
            out.append((text + (" " if text[-1] not in ' "\n' else "") + word(3), len(before), len(before) + len(body), label))
    return out


def examples(findings: list[tuple[str, int, int, int]]) -> tuple[list[tuple[str, list[tuple[int, int]]]], np.ndarray]:
    """Of each finding its text and the candidates' windows that a scan would score, and its label.

    A secret's windows are those that hold LEAST characters of it (or all of a shorter one), whatever part of the run
    a candidate is; findings that base spans cover have none and are left out.
    """
    out, labels = [], []
    for text, start, end, label in findings:
        cut = [w for c in candidates(text, base_spans(text)) for w in windows(*c)]
        mine = [(a, b) for a, b in cut if min(b, end) - max(a, start) >= min(LEAST, end - start, b - a)]
        if mine:
            out.append((text, mine))
            labels.append(label)
    return out, np.array(labels, np.float32)


def train(findings: list[tuple[str, int, int, int]] | None = None, recall: float = RECALL, epochs: int = 6, seed: int = 7) -> Network:
    """A network from labelled findings (text, start, end, label); by default 8,000 generated ones.

    It learns from windows of candidates as a scan cuts them. A quarter of the findings is held out, one half of it to
    calibrate the logits by a logistic curve and the other for the threshold: the largest score that still finds
    `recall` of its secrets.
    """
    shown, y = examples(labelled_findings(8000, seed) if findings is None else findings)
    side = np.arange(len(y)) % 16 // 2  # pairs of findings stay together, so each side has both labels
    codes = [np.array([_codes(t, a, b) for a, b in cut], np.int16).reshape(-1, WIDTH) for t, cut in shown]
    fit = np.flatnonzero(side < 6)
    x_fit = np.concatenate([codes[i] for i in fit]) if len(fit) else np.zeros((0, WIDTH), np.int16)
    y_fit = np.repeat(y[fit], [len(codes[i]) for i in fit])
    net, rng = Network(_start(seed)), np.random.default_rng(seed)
    moment = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y_fit))
        for at in range(0, len(order), 128):
            rows, step = order[at : at + 128], step + 1
            for k, g in _gradients(net, x_fit[rows], y_fit[rows]).items():
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.weights[k] = (net.weights[k] - 0.004 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    tuned, judged = np.flatnonzero(side == 6), np.flatnonzero((side == 7) & (y == 1))
    if len(tuned) and 0 < y[tuned].mean() < 1:
        from quillspark.llm.compression import calibrate

        logit = np.array([max(net.forward(codes[i])["logit"]) for i in tuned], np.float64)
        net.slope, net.shift = calibrate(logit, y[tuned])
    if len(judged):
        found = np.sort([net.scores(codes[i]).max() for i in judged])
        net.threshold = float(found[int((1 - recall) * len(found))])
    return net


def spans(text: str, net: Network | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind: the base ones and the network's."""
    found = base_spans(text)
    if net:
        more = list(candidates(text, found))
        if more:
            found += [("model", a, b) for (a, b), s in zip(more, net.candidate_scores(text, more), strict=True) if s >= net.threshold]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def as_text(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans and redacted of every row, over whole texts.

    redacted is the text with "[SECRET]" for every run of overlapping spans. Null and empty texts have no spans, and
    null texts stay null. Rows are scanned one by one, so order, ties, repeats and other columns play no part; null
    keys are carried along; an empty table gives no rows.
    """

    def run(keys: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "redacted")}
        for t in texts:
            found = spans(t, net)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in found))
            out["base_sha256"].append(hashlib.sha256(as_text([s for s in found if s[0] != "model"]).encode()).hexdigest())
            out["spans"].append(as_text(found))
            out["redacted"].append(redact(t, found) if found else t)
        return out | {"doc_id": keys}

    kind = df.schema[key].dataType.simpleString()
    return map_texts(narrowed(df, doc_id=key, text=text), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, redacted string")


def redacted(df: DataFrame, net: Network, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The rows of df, all columns, with secrets in the text replaced and the column `size`, if any, set anew.

    Null and empty texts, and texts without secrets, stay as they are, their sizes too. Rows are scanned one by one, so
    repeats and ties play no part; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    at, n = df.columns.index(text), df.columns.index(size) if size in df.columns else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t if t is None else redact(t, spans(t, net)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            if n is not None:
                old = zip(batch.column(at).to_pylist(), texts, columns[n].to_pylist(), strict=True)
                columns[n] = pa.array([c if a == b else len(b) for a, b, c in old], schema.field(n).type)
            columns[at] = pa.array(texts, schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train()).drop("redacted", "n_model")
