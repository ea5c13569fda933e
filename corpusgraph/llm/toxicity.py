"""Toxicity by non-negative positive-unlabelled learning.

A linear model over words and word beginnings (found at all, found three times)
is trained in numpy from confirmed toxic documents and unlabelled ones.  With class prior ``pi`` and loss ``l``, the
risk on negatives is estimated as the unlabelled risk less the share that the
positives have in it, and is kept from falling below zero:

    pi * E_pos[l(g)] + max(0, E_unl[l(-g)] - pi * E_pos[l(-g)])

The features are those that stand out in the positives against the unlabelled
sample.  Both samples are bounded (``POSITIVES``, ``UNLABELLED`` rows, one for an
id) and drawn by a hash of the id; the prior comes from all labels; all documents
are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Most documents in either sample, most features in the model, seed of the draw.
POSITIVES, UNLABELLED, FEATURES, SEED = 3000, 6000, 600, 7
#: Lengths of word beginnings; counts from which a feature holds; words a worker remembers.
BEGINNINGS, LEVELS, CACHE_WORDS = (4, 5, 6), (1, 3), 200_000
#: Score from which a document is called toxic.
CUT = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def names(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def features(text: str) -> Counter:
    """How often each feature is in the lower-cased text."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for name in names(word):
            found[name] += n
    return found


@dataclass
class Model:
    """weight: for each feature, what each level adds."""

    weight: dict[str, tuple[float, ...]]
    bias: float

    def __post_init__(self):
        self.cache: dict[str, list[str]] = {}

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "cache": {}}

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for t in texts:
            found: Counter = Counter()
            for word, n in Counter(_WORD.findall((t or "").lower())).items():
                known = self.cache.get(word)
                if known is None:
                    if len(self.cache) > CACHE_WORDS:
                        self.cache.clear()
                    known = self.cache[word] = [x for x in names(word) if x in self.weight]
                for name in known:
                    found[name] += n
            g = self.bias + math.fsum(w for x in found for w, k in zip(self.weight[x], LEVELS, strict=True) if found[x] >= k)
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, g)))))
        return out


def learns(doc_id="doc_id"):
    """Rows whose label may be learned from: not those held out, and not those without an id."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def held_out(doc_id="doc_id"):
    """The rows whose labels are never seen; a null id is none of them, and is not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positives and unlabelled documents each feature and level is."""
    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for positive, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[positive].update((x, k) for x, n in features(text).items() for k in LEVELS if n >= k)
        keys = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys]), pa.array([k for _, k in keys], pa.int32()), *(pa.array([seen[i][x] for x in keys], pa.int64()) for i in (1, 0))], ["feature", "level", "p", "u"])


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """A bounded sample: positive (1: confirmed toxic, 0: unlabelled), text; of the rows of one id, the least text."""
    draw = F.xxhash64("doc_id", F.lit(SEED))
    toxic = labels.where((F.col("toxic") == 1) & learns()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    toxic = toxic.orderBy(draw, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("positive"))
    rest = docs.where(learns()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(draw, "doc_id").limit(unlabelled)
    ids = toxic.unionByName(rest.select("doc_id", F.lit(0).alias("positive")))
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # positives + unlabelled rows at most, however often an id occurs
    return drawn.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text")


def prior_of(labels: DataFrame) -> float:
    """Share of toxic documents among all labels that may be learned from; 1/10 where there are none."""
    n, t = labels.where(learns() & F.col("toxic").isNotNull()).agg(F.count("*"), F.sum("toxic")).first()
    return min(0.5, max(0.005, t / n)) if n else 0.1


def nnpu(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) that lower the non-negative risk, by Adam over the whole sample."""
    pos, unl = x[y == 1], x[y == 0]
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        gp, gu = sig(pos @ w[:-1] + w[-1]), sig(unl @ w[:-1] + w[-1])
        slope = lambda rows, s: np.append(rows.T @ s, s.sum()) / len(rows)
        negative = -np.log1p(-np.minimum(gu, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(gp, 1 - 1e-9)).mean()
        d_neg = slope(unl, gu) - prior * slope(pos, gp)
        d_pos = prior * slope(pos, gp - 1)
        d = d_pos + d_neg if negative >= 0 else -d_neg
        d[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model; without positives or without documents, one that scores all alike by the prior.

    Rows without an id, in either table, are not learned from; a label given twice
    counts twice in the prior only."""
    prior = prior_of(labels)
    flat = Model({}, math.log(prior / (1 - prior)))
    drawn = written(sample(docs, labels), "toxicity-sample")
    n = dict(drawn.groupBy("positive").count().collect())
    if not n.get(0) or not n.get(1):
        return flat
    seen = drawn.mapInArrow(_counted, "feature string, level int, p long, u long").groupBy("feature", "level").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") / n[1], F.col("u") / n[0]
    far = (p - u) / F.sqrt((u + 1 / n[0]) * (1 / n[0] + 1 / n[1]))
    stand = seen.where(F.col("p") >= min(4, n[1])).withColumn("far", far).where("far > 4").orderBy(F.desc("far"), "feature", "level").limit(FEATURES)
    columns = [(r.feature, r.level) for r in stand.select("feature", "level").collect()]
    if not columns:
        return flat
    place = {x: i for i, x in enumerate(columns)}
    wanted = {x for x, _ in columns}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [{x: n for x, n in features(t).items() if x in wanted} for t in b.column(1).to_pylist()]
            at = [sorted(place[x, k] for x, n in f.items() for k in LEVELS if n >= k and (x, k) in place) for f in held]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], ["positive", "at"])

    got = sorted((r.positive, tuple(r.at)) for r in drawn.mapInArrow(rows, "positive int, at array<int>").collect())
    x = np.zeros((len(got), len(columns)), np.float32)
    for i, (_, at) in enumerate(got):
        x[i, list(at)] = 1
    w = nnpu(x, np.array([y for y, _ in got]), prior)
    weight = {name: tuple(float(w[place[name, k]]) if (name, k) in place else 0.0 for k in LEVELS) for name in sorted(wanted)}
    return Model(weight, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, score (0 to 1): the more, the likelier toxic.

    A null or empty text gets the score of no words.  Null ids and repeated rows
    each give a row, equal texts equal scores; other columns are not read.  An
    empty table gives no rows.  Texts are read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` without those that score ``cut`` or more; all columns and repeated rows stay.

    Each row is judged by its own text, so null and repeated ids neither save nor
    cost a row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array([s < cut for s in shared.value.scores(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
