"""Secret scans: fixed rules, and a character convolutional network over every candidate in its context.

Base rules give spans that always stay.  Every token of 16 key characters or more
is a candidate; a small network (numpy) reads the candidate and what surrounds it
and adds those above a threshold.  It is trained on labelled findings: examples
of public key formats and of look-alikes made from a seed, and what the base
rules say of a bounded sample of documents; what they leave is taken for harmless
only where a first network, of the made examples, does not call it a secret.
Scores are calibrated on a validation part (Platt), and the threshold is the
highest that keeps ``RECALL`` of its secrets.  A long candidate is read in
overlapping windows and has the highest of their scores.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

# The base rules.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate: a token of key characters.  Before and behind it the network reads context.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
BEFORE, INSIDE, BEHIND = 20, 40, 4
WIDTH = BEFORE + INSIDE + BEHIND
RECALL = 0.98
#: Characters from one window of a long candidate to the next.
STEP = 8
#: Documents whose base findings are learned from, findings of each label taken from them, made examples of each label, seed.
SAMPLE_DOCS, SAMPLE_FINDINGS, MADE, SEED = 2000, 400, 1200, 5

_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:\"' ,@\n|#"
_CODE = {c: i + 2 for i, c in enumerate(_CHARS)}  # 0: nothing there, 1: any other
N_CODES = len(_CHARS) + 2


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower() if not text.isascii() else text.casefold()
        # a text whose folded form has another length still holds the words it held
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, first and last place to read) of each token of key characters.

    Of a token that base findings touch, each part outside them is a candidate; a
    part that is too short for a token is read together with the whole token."""
    out = []
    for m in _TOKEN.finditer(text):
        a, z = m.span()
        at = a
        for s, e in sorted((s, e) for s, _, e in taken if s < z and a < e) + [(z, z)]:
            if s > at:
                out.append((at, s, *((at, s) if s - at >= 16 else (a, z))))
            at = max(at, e)
    return out


def windows(a: int, z: int) -> list[tuple[int, int]]:
    """Overlapping stretches of INSIDE characters that cover a candidate, the last one at its end."""
    if z - a <= INSIDE:
        return [(a, z)]
    return [(k, k + INSIDE) for k in [*range(a, z - INSIDE, STEP), z - INSIDE]]


def encode(text: str, a: int, z: int) -> list[int]:
    head = text[max(0, a - BEFORE) : a]
    body = text[a : min(z, a + INSIDE)]
    tail = text[z : z + BEHIND]
    code = lambda s: [_CODE.get(c, 1) for c in s]
    return [0] * (BEFORE - len(head)) + code(head) + code(body) + [0] * (INSIDE - len(body)) + code(tail) + [0] * (BEHIND - len(tail))


@dataclass
class Network:
    """Embedding, one convolution of width 5, maximum and mean over places, a dense layer."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    bias: float
    threshold: float = 0.5
    slope: float = 1.0
    shift: float = 0.0
    recall: float = 1.0  # of the validation part's secrets, at the threshold

    def hidden(self, codes: np.ndarray):
        x = self.embed[codes]
        win = np.concatenate([x[:, i : WIDTH - 4 + i] for i in range(5)], axis=2)
        return win, np.maximum(0, win @ self.conv + self.conv_bias)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for k in range(0, len(codes), 1024):
            _, h = self.hidden(codes[k : k + 1024])
            out.append(np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1) @ self.dense + self.bias)
        return np.concatenate(out)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated scores."""
        return _sigmoid(self.slope * self.raw(codes) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through ``raw``, with Platt's targets, by damped Newton steps; a falling curve is not taken."""
    yes, no = int((y == 1).sum()), int((y != 1).sum())
    if not yes or not no:
        return 1.0, 0.0
    want = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    loss = lambda w: float((np.logaddexp(0, x @ w) - want * (x @ w)).sum())
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - want))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(codes: np.ndarray, y: np.ndarray, rounds: int = 12, dim: int = 8, filters: int = 24) -> Network:
    """A network by Adam on batches of 64, its calibration and threshold from every fifth example, which it does not train on."""
    r = np.random.default_rng(SEED)
    p = [r.normal(0, 0.3, (N_CODES, dim)), r.normal(0, 0.2, (5 * dim, filters)), np.zeros(filters), r.normal(0, 0.2, 2 * filters), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    held = np.arange(len(y)) % 5 == 4
    rows, t = np.flatnonzero(~held), 0
    for _ in range(rounds):
        order = r.permutation(rows)
        for k in range(0, len(order), 64):
            c, want = codes[order[k : k + 64]], y[order[k : k + 64]]
            net = Network(*p[:4], float(p[4][0]))
            win, h = net.hidden(c)
            top = h.argmax(axis=1)
            f = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
            d = (1 / (1 + np.exp(-np.clip(f @ p[3] + p[4], -30, 30))) - want) / len(c)
            df = d[:, None] * p[3]
            dh = np.repeat(df[:, None, filters:] / h.shape[1], h.shape[1], axis=1)
            i, j = np.indices(top.shape)
            dh[i, top, j] += df[:, :filters]
            dh *= h > 0
            dwin = dh @ p[1].T
            dx = np.zeros((len(c), WIDTH, dim))
            for s in range(5):
                dx[:, s : WIDTH - 4 + s] += dwin[:, :, s * dim : (s + 1) * dim]
            de = np.zeros_like(p[0])
            np.add.at(de, c, dx)
            grads = [de, np.einsum("nwa,nwb->ab", win, dh), dh.sum(axis=(0, 1)), f.T @ d, np.array([d.sum()])]
            t += 1
            for q, (g, a, b) in enumerate(zip(grads, m, v, strict=True)):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p[q] = p[q] - 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net = Network(*p[:4], float(p[4][0]))
    net.slope, net.shift = platt(net.raw(codes[held]), y[held])
    good = np.sort(net.scores(codes[held & (y == 1)]))
    if len(good):
        net.threshold = float(good[int((1 - RECALL) * len(good))])
        net.recall = float((good >= net.threshold).mean())
    return net


def made(n: int = MADE, seed: int = SEED, without: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): key formats that are public, and look-alikes that are no secrets.

    ``without`` leaves out key formats by number, ``only`` takes no others."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ou", "ment", "que", "ción", "sch", "ung", "la", "de", "tion"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    plain = lambda: "".join(c for c in word() if c.isascii())
    secret = [
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "gho_" + pick(alnum, 36),
        lambda: "glpat-" + pick(alnum + "_", 20),
        lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick("0123456789", 12) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "sk-" + pick(alnum, 40),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum, r.randrange(20, 60)),
        lambda: pick(alnum + "+/", r.randrange(32, 65)) + r.choice(["", "=", "=="]),
        lambda: "npm_" + pick(alnum, 36),
        lambda: pick(alnum[26:52], r.randrange(2, 7)) + r.choice("_-") + pick(alnum, r.randrange(16, 50)),
        lambda: "-".join(pick(r.choice([alnum, alnum, alnum[52:]]), r.randrange(8, 20)) for _ in range(r.randrange(1, 4))) + "-" + pick(alnum, 20),
    ]
    harmless = [
        lambda: pick("0123456789", r.randrange(16, 20)),
        lambda: "-".join(pick("0123456789", 4) for _ in range(4)),
        lambda: "-".join(plain() for _ in range(r.randrange(3, 7))) + pick("0123456789", 2),
        lambda: "_".join(plain() or "x" for _ in range(r.randrange(3, 7))) + "2",
        lambda: "/" + "/".join(plain() or "a" for _ in range(5)) + "/" + pick("0123456789", 4),
        lambda: "".join(plain().capitalize() for _ in range(r.randrange(4, 9))) + "Ab",
        lambda: "2024-0" + pick("123456789", 1) + "-1" + pick("0123456789", 1) + "T12-30-00Z",
        lambda: "=" * r.randrange(10, 30) + "1" + "-" * 8,
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: plain() + "".join(plain() for _ in range(4)) + "Xy" + plain() + "er",
        lambda: "".join(plain() for _ in range(r.randrange(5, 12))),
        lambda: "".join(plain() for _ in range(r.randrange(5, 12))).upper(),
        lambda: "-".join(plain() for _ in range(r.randrange(4, 8))),
        lambda: r.choice("=-_+/ox") * r.randrange(16, 60),
    ]
    secret = [f for k, f in enumerate(secret) if k not in without and (not only or k in only)]
    lead = ["key: ", "auth ", "Authorization: Bearer ", 'KEY="', "credential=", "", "", ""]
    out = []
    for k in range(2 * n):
        label = k % 2
        t = r.choice(secret if label else harmless)()
        t = t if len(t) >= 16 else t + pick("0123456789", 16 - len(t))
        head = " ".join(word() for _ in range(r.randrange(0, 6))) + " " + r.choice(lead)
        out.append((head + t + r.choice([" ", '"', ".", "\n"]) + word(), len(head), len(head) + len(t), label))
    return out


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(0).to_pylist():
            spans = base(text)
            for a, _, z in spans:
                value = max(a, z - INSIDE)
                rows.append((encode(text, value, z), 1))
            # a part beside a base finding is of the same key as often as not: no label
            rows += [(encode(text, *w), 0) for a, z, lo, hi in candidates(text, spans) if not any(s <= hi and lo <= e for s, _, e in spans) for w in windows(lo, hi)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.int32())), pa.array([y for _, y in rows], pa.int32())], ["codes", "label"])


def train(docs: DataFrame) -> Network:
    """A network from made examples and from at most SAMPLE_FINDINGS findings of each label in SAMPLE_DOCS documents.

    The sample is of distinct ids, one row (the least text) for each; null ids and
    texts are not in it.  An empty table leaves the made examples."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE_DOCS)
    drawn = docs.where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    found = written(drawn.mapInArrow(_findings, "codes array<int>, label int"), "secrets-sample")
    codes = [encode(text, a, z) for text, a, z, _ in made()]
    labels = [label for *_, label in made()]
    first = fit(np.array(codes, np.int32), np.array(labels, np.float64))
    for label in (0, 1):
        part = found.where(F.col("label") == label).select("codes").distinct().orderBy(F.xxhash64("codes"), "codes").limit(SAMPLE_FINDINGS)
        part = [list(r.codes) for r in part.collect()]
        if part and not label:
            part = [c for c, s in zip(part, first.scores(np.array(part, np.int32)).tolist(), strict=True) if s < first.threshold]
        codes += part
        labels += [label] * len(part)
    return fit(np.array(codes, np.int32), np.array(labels, np.float64))


def _scan_texts(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of all findings of each text; kind 3 is the network's."""
    found, codes, where = [], [], []
    for i, t in enumerate(texts):
        spans = base(t) if t else []
        found.append([(a, k, z, 1.0) for a, k, z in spans])
        if t:
            for a, z, lo, hi in candidates(t, spans):
                where.append((i, a, z, len(codes)))
                codes += [encode(t, *w) for w in windows(lo, hi)]
    if codes:
        best = np.maximum.reduceat(net.scores(np.array(codes, np.int32)), [k for *_, k in where])
        for (i, a, z, _), s in zip(where, best.tolist(), strict=True):
            if s >= net.threshold:
                found[i].append((a, 3, z, s))
    return [sorted(f) for f in found]


SPANS = "doc_id long, spans array<struct<start:int,stop:int,kind:string,score:double>>"


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and spans (start, stop in code points, kind, score) of each row of ``docs`` (doc_id, text).

    Kinds: assign, access, hex (base rules, leftmost and without overlap within a
    kind), network.  A null or empty text has no span.  Texts are read whole.
    Repeated rows give equal rows; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kinds = (*KINDS, "network")
    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _scan_texts(b.column(1).to_pylist(), shared.value)
            spans = [[{"start": a, "stop": z, "kind": kinds[k], "score": s} for a, k, z, s in f] for f in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind_of)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def redact(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each finding (overlapping ones as one) replaced by ``mark``; all rows and columns stay, n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    long = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(at).to_pylist()
            for i, spans in enumerate(_scan_texts(texts, shared.value)):
                if not spans:
                    continue
                out, done = [], 0
                for a, _, z, _ in spans:
                    if a >= done:
                        out += [texts[i][done:a], mark]
                    done = max(done, z)
                texts[i] = "".join(out) + texts[i][done:]
            columns = list(b.columns)
            if long is not None:
                was = columns[long].to_pylist()
                old = columns[at].to_pylist()
                columns[long] = pa.array([w if n == o or n is None else len(n) for w, n, o in zip(was, texts, old, strict=True)], columns[long].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
