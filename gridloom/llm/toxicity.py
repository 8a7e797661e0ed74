"""Toxicity: a logistic classifier that is held to the same score when identity terms are swapped.

Features are words and word beginnings, each once a document. Training adds to the log loss a penalty on the
squared change of the score between a labelled text and its counterfactual, in which every identity term is
replaced by another of its kind; so a neutral mention of a group says nothing about toxicity.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)  # letters of a word's beginnings
#: Bounds: documents of a label in the training sample (expected), words a worker remembers.
SAMPLE, CACHE = 3000, 1 << 18
FOLDS = 3  # parts of the sample, each scored by a model of the rest to calibrate the scores
STEPS, RATE, DECAY, PENALTY, THRESHOLD = 400, 0.3, 2e-4, 1.0, 0.3
#: Identity terms by kind; within a kind, one stands for another in a counterfactual.
IDENTITY = (
    "women men girls boys frauen männer femmes hommes mujeres hombres",
    "woman man girl boy frau mann femme homme mujer hombre",
    "muslims christians jews hindus buddhists atheists muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab african european",
    "gay lesbian straight bisexual transgender queer",
    "immigrants refugees foreigners locals natives migrants ausländer flüchtlinge immigrés réfugiés inmigrantes refugiados",
    "deaf blind disabled autistic elderly young",
)


def swaps(kinds: tuple[str, ...] = IDENTITY) -> dict[str, str]:
    """Each identity term to the next one of its kind, in a circle."""
    return {a: b for k in kinds for a, b in zip(k.split(), [*k.split()[1:], k.split()[0]], strict=True)}


def features(words: Iterable[str]) -> set[str]:
    """Distinct words, and their beginnings (marked by ^)."""
    words = set(words)
    return words | {f"^{w[:n]}" for w in words for n in STEMS if len(w) > n}


def hashed(words: Iterable[str]) -> np.ndarray:
    """Sorted 64-bit hashes of the features of some words."""
    f = features(words)
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, f), np.uint64, len(f)))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def scaled(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def mirrored(words: list[str], swap: dict[str, str]) -> np.ndarray | None:
    """The hashed features of the counterfactual of some words; None if no identity term is among them."""
    return None if swap.keys().isdisjoint(words) else hashed(swap.get(w, w) for w in words)


class Model:
    """Weights by feature hash. The empty model (no labels to learn from) scores everything 0."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def logit(self, features: Iterable[int]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features)

    def score(self, text: str | None) -> float:
        return self.scores([text], {})[0]

    def scores(self, texts: list[str | None], known: dict[str, tuple[int, ...]]) -> list[float]:
        """The score of each text; ``known`` remembers which weighted features a word has (most have none)."""
        get, out = self.weights.get, []
        for text in texts:
            live: set[int] = set()
            for w in set(words_of(text)):
                if (fs := known.get(w)) is None:
                    if len(known) > CACHE:
                        known.clear()
                    fs = known[w] = tuple(f for f in hashed((w,)).tolist() if f in self.weights)
                live.update(fs)
            out.append(float(scaled(np.float64(self.bias + sum(map(get, sorted(live)))))))
        return out


def fit(texts: list[str], labels: list[int], penalty: float = PENALTY, kinds: tuple[str, ...] = IDENTITY, prior: float | None = None) -> Model:
    """``learn`` from texts."""
    swap = swaps(kinds)
    words = [words_of(t) for t in texts]
    return learn([hashed(w) for w in words], [mirrored(w, swap) for w in words], labels, penalty, kinds, prior)


def learn(
    rows: list[np.ndarray], mirrors: list[np.ndarray | None], labels: list[int], penalty: float = PENALTY,
    kinds: tuple[str, ...] = IDENTITY, prior: float | None = None,
) -> Model:
    """Counterfactually regularised logistic regression over the telling features of some texts, by hash.

    ``mirrors`` has the features of a text's counterfactual. Both labels weigh the same while it learns. Then the
    scores are calibrated on texts that a model has not seen, each fold of the sample by the rest, with ``prior`` the
    share of label 1 among all rows (of ``labels`` unless given).
    """
    if not rows:
        return Model({}, -40.0)
    share = min(max(sum(labels) / len(labels) if prior is None else prior, 1e-6), 1 - 1e-6)
    y = np.array(labels, np.float64)
    weights, bias = regress(rows, mirrors, y, penalty, kinds)
    if min(labels.count(0), labels.count(1)) < 10 * FOLDS:
        return Model(weights, float(bias + np.log(share / (1 - share))))
    z = np.zeros(len(rows))
    for fold in range(FOLDS):
        rest = [k for k in range(len(rows)) if k % FOLDS != fold]
        model = Model(*regress([rows[k] for k in rest], [mirrors[k] for k in rest], y[rest], penalty, kinds))
        z[fold::FOLDS] = [model.logit(rows[k].tolist()) for k in range(fold, len(rows), FOLDS)]
    slope, shift = calibration(z, y, np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()))
    return Model({k: v * slope for k, v in weights.items()}, float(bias * slope + shift))


def calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope, of 1 at least, and shift by which logits ``z`` best fit the labels: Newton's steps, kept from an end
    at infinity by a little weight on a slope of 1."""
    x, at = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    keep = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = scaled(x @ at)
        grad = x.T @ (weight * (p - y)) + keep @ (at - [1.0, 0.0])
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + keep, grad)
        at = at - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return max(1.0, float(at[0])), float(at[1])


def regress(
    rows: list[np.ndarray], mirrors: list[np.ndarray | None], y: np.ndarray, penalty: float, kinds: tuple[str, ...],
) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias. A feature takes part if its document frequencies under the two labels are
    further apart than the largest of so many differences is by chance, sqrt(2 ln(features)) standard errors."""
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    known, place = np.unique(np.concatenate(rows), return_inverse=True)
    ones = np.bincount(place, np.repeat(y, [len(r) for r in rows]), len(known))
    every = np.bincount(place, minlength=len(known))
    del place
    p, q, m = ones / n[1], (every - ones) / n[0], every / (n[0] + n[1])
    worth = np.abs(p - q) / np.sqrt(m * (1 - m) * (1 / n[0] + 1 / n[1]) + 1e-12)
    telling = known[worth > np.sqrt(2 * np.log(max(2, len(known))))]
    index = np.union1d(telling, np.intersect1d(known, hashed(swaps(kinds))))
    d = len(index)

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate([np.zeros(0, np.uint64), *rows])
        at = np.minimum(np.searchsorted(index, flat), max(0, d - 1))
        live = index[at] == flat if d else np.zeros(len(flat), bool)
        return own[live], at[live]

    met = [k for k, x in enumerate(mirrors) if x is not None]
    (r, c), (r1, c1), (r2, c2) = matrix(rows), matrix([rows[k] for k in met]), matrix([mirrors[k] for k in met])
    weight = np.where(y == 1, 1 / n[1], 1 / n[0]) / 2
    w, bias, speed = np.zeros(d), 0.0, np.full(d + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(r, w[c], len(y)) + bias
        g = weight * (scaled(z) - y)
        grad = np.bincount(c, g[r], d) + DECAY * w
        if met:
            change = np.bincount(r1, w[c1], len(met)) - np.bincount(r2, w[c2], len(met))
            push = 2 * penalty * change / len(met)
            grad += np.bincount(c1, push[r1], d) - np.bincount(c2, push[r2], d)
        speed[:d] += grad * grad
        speed[d] += g.sum() ** 2
        w -= RATE * grad / np.sqrt(speed[:d])
        bias -= RATE * g.sum() / np.sqrt(speed[d])
    return dict(zip(index.tolist(), w.tolist(), strict=True)), float(bias)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """A model of the labelled rows that ``allowed`` (over the label rows) admits.

    The sample is bounded: about ``sample`` documents a label, chosen by a hash of the id; the labels are counted
    over all rows. Texts become hashed features where they are; only these come to the driver. Rows with a null
    label, id or text are not learned from; of an id's rows the greatest label and the least text count; very long
    texts are taken whole; empty tables give a model that scores 0.
    """
    known = labels.where(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i_"), F.col(label_col).cast("int").alias("y_"))
    count = {r[0]: r[1] for r in known.groupBy("y_").count().collect()}
    share = F.coalesce(*(F.when(F.col("y_") == k, F.lit(min(1.0, sample / n))) for k, n in count.items()), F.lit(0.0))
    chance = F.pmod(F.xxhash64(F.col("i_"), F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row an id, so the sample is bounded whatever is repeated; that makes it small enough to broadcast
    drawn = known.where(chance < share).groupBy("i_").agg(F.max("y_").alias("y_"))
    found = docs.select(docs[id_col].alias("d_"), F.col(text_col).alias("t")).join(F.broadcast(drawn), F.col("d_") == F.col("i_"))
    swap = swaps()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in text_slices(batches, "t"):
            words = [words_of(t) for t in b.column("t").to_pylist()]
            plain, other = [hashed(w).view(np.int64) for w in words], [mirrored(w, swap) for w in words]
            yield pa.record_batch([b.column("i"), b.column("y"), pa.array(plain, kind), pa.array([None if x is None else x.view(np.int64) for x in other], kind)], names=["i", "y", "x", "mirror"])

    texts = found.where("t is not null").groupBy("i_", "y_").agg(F.min("t").alias("t"))
    rows = texts.select(F.xxhash64("i_").alias("i"), F.col("y_").alias("y"), "t").mapInArrow(run, "i long, y int, x array<long>, mirror array<long>").toArrow().sort_by("i")
    cells = lambda c: [None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in rows.column(c)]
    prior = 1 - count.get(0, 0) / max(1, sum(count.values()))
    return learn(cells("x"), cells("mirror"), [int(y != 0) for y in rows.column("y").to_pylist()], penalty, prior=prior)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row: score in 0 to 1, predicted 1 if it is ``threshold`` or more.

    Whole texts, no shuffle. Null and empty texts get the score of a text without words; null ids and repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the telling features of the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for b in text_slices(batches, "t"):
            yield pa.record_batch([b.column("i"), pa.array(model.scores(b.column("t").to_pylist(), known), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
