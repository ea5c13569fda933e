"""Language identification in two steps: the family first, then its languages.

Features are hashed byte pairs and triples of the lower-cased letters of the
whole text.  Linear support vector machines (numpy) tell each family from the
rest; within the family that wins, one machine for each pair of its languages
votes.  Training takes at most ``PER_LANGUAGE`` documents of each language, and
``SAMPLE`` of all, drawn by a hash of id and text; every document is predicted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Most documents learned from, for each language and in all; most languages (the commonest ones);
#: hash cells of the features; seed of the draw.
PER_LANGUAGE, SAMPLE, LANGUAGES, CELLS, SEED = 700, 14_000, 400, 4096, 11

# The family of each language code; any other code is a family of its own.
FAMILIES = {
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "sk", "cs", "pl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_SPLIT = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def _lettered(text: str | None) -> bool:
    """Whether a text has a letter."""
    return any(map(str.isalpha, text or ""))


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0], code)


def counts(text: str) -> np.ndarray:
    """How often each cell is hit, as a unit vector; zero without letters."""
    raw = text.lower().encode("utf-8", "replace").translate(_SPLIT)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    pair = b[:-1] * np.uint32(257) + b[1:]
    triple = pair[:-1] * np.uint32(8191) + b[2:] * np.uint32(31)
    got = np.bincount((pair * np.uint32(2654435761)) >> np.uint32(32 - 10), minlength=1024)
    more = np.bincount(((triple * np.uint32(2654435761)) >> np.uint32(32 - 12)) % np.uint32(CELLS - 1024), minlength=CELLS - 1024)
    x = np.sqrt(np.concatenate([got, more]).astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge, y in -1 and 1, by accelerated descent; classes weigh alike.

    It ends when no weight moves by a thousandth of the largest."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, pace = w.copy(), 1.0
    step = np.float32(1 / (1 / c + 2 * 2))
    for _ in range(rounds):
        margin = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * weight * y * margin
        slope = np.append(x.T @ pull + ahead[:-1] / np.float32(50 * c), pull.sum())
        after = ahead - step * slope
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        moved = np.abs(after - w).max()
        ahead, w, pace = after + np.float32((pace - 1) / faster) * (after - w), after, faster
        if moved < 1e-3 * np.abs(w).max():
            break
    return w


@dataclass
class Model:
    """machines: (CELLS, n) weights and n biases; family machines come first, one pair machine each after them."""

    families: list[str]
    pairs: list[tuple[str, str]]
    members: dict[str, list[str]]
    weight: np.ndarray
    bias: np.ndarray
    slope: float = 6.0
    _at: dict = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        sure = lambda z: 1 / (1 + float(np.exp(-np.clip(self.slope * z, -40, 40))))
        for t in texts:
            if not self.families or not _lettered(t):
                names.append("und")
                scores.append(0.0)
                continue
            g = counts(t) @ self.weight + self.bias
            best = int(np.argmax(g[: len(self.families)])) if len(self.families) > 1 else 0
            p = sure(g[best]) if len(self.families) > 1 else 1.0
            langs = self.members[self.families[best]]
            votes = dict.fromkeys(langs, 0.0)
            sums = dict.fromkeys(langs, 0.0)
            for a, b in itertools.combinations(langs, 2):
                z = g[len(self.families) + self._at[a, b]]
                votes[a if z >= 0 else b] += 1
                sums[a] += sure(z)
                sums[b] += sure(-z)
            top = max(langs, key=lambda x: (votes[x], sums[x], x))
            names.append(top)
            scores.append(p * (sums[top] / (len(langs) - 1) if len(langs) > 1 else 1.0))
        return names, scores


def learns(doc_id="doc_id"):
    """Rows whose language may be learned from: not those held out, and not those without an id."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def held_out(doc_id="doc_id"):
    """The rows whose languages are never seen; a null id is none of them, and is not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text of the rows learned from, each distinct row once: the ``per_language`` least hashes of each language.

    Rows are counted for each language, a bound on the hash leaves about twice as
    many as wanted wherever they lie, and only these few are ranked."""
    draw = F.xxhash64("doc_id", "text", F.lit(SEED))
    named = docs.where(learns() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", draw.alias("draw"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    most = min(per_language, SAMPLE // max(1, sizes.count()))
    # a hash of 64 bits, as a share of all
    share = (F.col("draw").cast("double") + 2.0**63) / 2.0**64
    bounds = sizes.select("lang", ((2.0 * most + 100) / F.col("n")).alias("bound"))
    some = named.join(F.broadcast(bounds), "lang").where(share < F.col("bound")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    some = written(some, "language-sample")
    # of two to three times ``most`` rows for each language
    best = some.select("lang", "draw", F.row_number().over(Window.partitionBy("lang").orderBy("draw")).alias("k")).where(F.col("k") <= most)
    return some.join(F.broadcast(best.select("lang", "draw")), ["lang", "draw"]).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages that ``docs`` (doc_id, text, lang) names; without any, one that answers ``und``.

    Rows without id, text or lang, and texts without a letter, are not learned
    from; equal rows count once."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t).astype("<f2").tobytes() if _lettered(t) else None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["lang", "x"])

    # SAMPLE rows at most
    rows = sorted((r.lang, bytes(r.x)) for r in sample(docs, per_language).mapInArrow(vectors, "lang string, x binary").where("x IS NOT NULL").collect())
    langs = sorted({lang for lang, _ in rows})
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family(lang), []).append(lang)
    families = sorted(members)
    x = np.array([np.frombuffer(v, "<f2") for _, v in rows], np.float32).reshape(-1, CELLS)
    y = np.array([lang for lang, _ in rows])
    home = np.array([family(lang) for lang, _ in rows])
    fitted = [svm(x, np.where(home == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [np.zeros(CELLS + 1)] * len(families)
    pairs = [(a, b) for f in families for a, b in itertools.combinations(members[f], 2)]
    for a, b in pairs:
        own = (y == a) | (y == b)
        fitted.append(svm(x[own], np.where(y[own] == a, 1.0, -1.0)))
    w = np.array(fitted).reshape(-1, CELLS + 1)
    return Model(families, pairs, members, w[:, :-1].T.astype(np.float32).copy(), w[:, -1].copy(), _at={p: i for i, p in enumerate(pairs)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each row of ``docs`` (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned.  Repeated rows are answered alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
