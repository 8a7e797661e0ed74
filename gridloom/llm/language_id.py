"""Language identification: a bidirectional gated recurrent network over bytes.

Trained here, in numpy, by backpropagation through time. A text's UTF-8 bytes are cut into windows that run
through the network side by side; the network gives a language distribution at every byte, and a document's
distribution is their mean over all its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

HIDDEN, WINDOW, LANES = 12, 96, 4096
#: Bound of the training sample: so many documents a language, expected, and windows of each.
SAMPLE, WINDOWS_A_DOC = 400, 4
STEPS, BATCH, RATE, SEED = 260, 256, 0.02, 7
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction: input weights by byte, recurrent weights, biases; gates in the order reset, update, new."""

    def __init__(self, rng: np.random.Generator, hidden: int, labels: int):
        f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.w, self.u, self.v = f(3 * hidden, 256), f(3 * hidden, hidden), f(labels, hidden)
        self.b = np.zeros((3 * hidden, 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.w, self.u, self.v, self.b]

    def forward(self, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """Label scores at each step of ``x`` (steps, lanes); ``keep`` collects what the way back needs."""
        n = self.u.shape[1]
        table = np.ascontiguousarray((self.w + self.b).T)
        h = np.zeros((n, x.shape[1]), np.float32)
        for row in x:
            a = table[row].T
            q = self.u @ h
            g = sigmoid(a[: 2 * n] + q[: 2 * n])
            r, z = g[:n], g[n:]
            new = np.tanh(a[2 * n:] + r * q[2 * n:])
            if keep is not None:
                keep.append((h, r, z, new, q[2 * n:]))
            h = new + z * (h - new)
            yield self.v @ h

    def backward(self, x: np.ndarray, kept: list, dy: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights for score gradients ``dy`` (steps, labels, lanes)."""
        n, steps = self.u.shape[1], len(x)
        du, dv = np.zeros_like(self.u), np.zeros_like(self.v)
        da = np.empty((steps, 3 * n, x.shape[1]), np.float32)
        dh = np.zeros((n, x.shape[1]), np.float32)
        for t in range(steps - 1, -1, -1):
            h, r, z, new, q = kept[t]
            after = new + z * (h - new)
            dv += dy[t] @ after.T
            dh = dh + self.v.T @ dy[t]
            dn = dh * (1 - z) * (1 - new * new)
            dq = np.concatenate([dn * q * r * (1 - r), dh * (h - new) * z * (1 - z), dn * r])
            da[t, : 2 * n], da[t, 2 * n:] = dq[: 2 * n], dn
            du += dq @ h.T
            dh = dh * z + self.u.T @ dq
        flat = da.transpose(1, 0, 2).reshape(3 * n, -1)
        dw = np.stack([np.bincount(x.ravel(), row, 256) for row in flat]).astype(np.float32)
        return [dw, du, dv, flat.sum(1, keepdims=True)]


class Model:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Gru(rng, hidden, len(labels)), Gru(rng, hidden, len(labels))
        self.c = np.zeros((len(labels), 1), np.float32)

    def probabilities(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """(steps, labels, lanes): the distribution at every byte of ``x`` (steps, lanes)."""
        y = np.empty((len(x), len(self.labels), x.shape[1]), np.float32)
        for t, s in enumerate(self.back.forward(x[::-1], keep and keep[1])):
            y[len(x) - 1 - t] = s
        for t, s in enumerate(self.ahead.forward(x, keep and keep[0])):
            y[t] += s + self.c
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def fit(self, x: np.ndarray, valid: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam over mini-batches of windows: x, valid (windows, steps); label (windows)."""
        rng = np.random.default_rng(seed)
        params = [*self.ahead.weights(), *self.back.weights(), self.c]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            bx, bv = np.ascontiguousarray(x[pick].T), valid[pick].T.astype(np.float32)
            keep: tuple[list, list] = ([], [])
            dy = self.probabilities(bx, keep)
            dy[:, label[pick], np.arange(BATCH)] -= 1
            dy *= (bv / max(1.0, float(bv.sum())))[:, None, :]
            grads = [*self.ahead.backward(bx, keep[0], dy), *self.back.backward(bx[::-1], keep[1], dy[::-1]), dy.sum((0, 2))[:, None]]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g *= min(1.0, 1.0 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (count, WINDOW), how many bytes of each are text, and the text that each is from."""
        size = np.array([len(t) for t in texts], np.int64)
        count = -(-size // WINDOW)
        padded = b"".join(t + bytes(-len(t) % WINDOW) for t in texts)
        x = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
        own = np.repeat(np.arange(len(texts)), count)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        return x, np.minimum(WINDOW, size[own] - inner * WINDOW), own

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): the mean distribution over all bytes of each text; zeros for an empty one."""
        x, n, own = self.windows(texts)
        total = np.zeros((len(texts), len(self.labels)))
        for k in range(0, len(x), LANES):
            part = np.ascontiguousarray(x[k:k + LANES].T)
            y = self.probabilities(part)
            y *= (np.arange(WINDOW)[:, None] < n[k:k + LANES])[:, None, :]
            sums = y.sum(0).astype(np.float64)
            for j, row in enumerate(sums):
                total[:, j] += np.bincount(own[k:k + LANES], row, len(texts))
        return total / np.maximum(1, [[len(t)] for t in texts])

    def positions(self, text: str) -> list[tuple[int, int, str]]:
        """(first byte, end, language) stretches of a text by the likeliest language at every byte."""
        raw = text.encode()
        x, n, _ = self.windows([raw])
        best = [self.probabilities(np.ascontiguousarray(x[k:k + LANES].T)).argmax(1).T for k in range(0, len(x), LANES)]
        label = np.concatenate(best).ravel()[: len(raw)] if best else np.zeros(0, np.int64)
        edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)] if len(label) else [0]
        return [(a, b, self.labels[label[a]]) for a, b in zip(edges, edges[1:], strict=False)]


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the labelled rows that ``allowed`` admits; None if there are none.

    The sample is bounded: about ``sample`` documents a language, chosen by a hash of the id, and
    WINDOWS_A_DOC windows of each at a hash-drawn place. Languages are counted over all rows. Rows with a null id,
    text or label are not learned from; of an id's rows the least counts; an empty table gives None.
    """
    rows = docs.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    count = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    if not count:
        return None
    labels = sorted(count)
    share = F.create_map(*(F.lit(v) for lang in labels for v in (lang, min(1.0, sample / count[lang]))))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("spot")), F.greatest(F.length(text_col) - WINDOW * WINDOWS_A_DOC, F.lit(1)))
    piece = F.substring(F.col(text_col), (spot + 1).cast("int"), F.lit(WINDOW * WINDOWS_A_DOC))
    # one row an id, so the sample is bounded whatever is repeated
    picked = rows.where(chance < share[F.col(label_col)]).groupBy(F.col(id_col).alias("i")).agg(F.min(F.struct(piece.alias("t"), F.col(label_col).alias("l"))).alias("r"))
    drawn = sorted(picked.select("i", "r.*").collect(), key=lambda r: (r.i, r.t))
    x, valid, label = [], [], []
    for r in drawn:
        raw = r.t.encode()
        for k in range(0, max(1, len(raw) - WINDOW // 2), WINDOW):
            w = raw[k:k + WINDOW]
            if w:
                x.append(np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8))
                valid.append(np.arange(WINDOW) < len(w))
                label.append(labels.index(r.l))
    if not x:
        return None
    # every language is drawn as often, whatever its share of the rows
    label = np.array(label)
    rng = np.random.default_rng(SEED)
    most = max(np.bincount(label))
    even = np.concatenate([rng.choice(np.flatnonzero(label == k), most) for k in np.unique(label)])
    model = Model(labels)
    model.fit(np.stack(x)[even], np.stack(valid)[even], label[even])
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its language: doc_id, lang_pred, score, or the columns of ``keep`` instead of doc_id.

    The score is the mean probability of the predicted language over all bytes of the whole text; of equal
    languages the first in order is taken. A text that is null or has no letter is ``und`` with score 0, and so
    is every text without a model. No shuffle; repeated rows, null ids and very long texts stay whole; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in text_slices(batches, "t"):
            texts = b.column("t").to_pylist()
            able = [k for k, t in enumerate(texts) if t and model and LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if able:
                for k, p in zip(able, model.pooled([texts[k].encode() for k in able]), strict=True):
                    best = int(p.argmax())
                    lang[k], score[k] = model.labels[best], min(1.0, float(p[best]))
            yield pa.record_batch([b.column("k"), pa.array(lang), pa.array(score, pa.float64())], names=["k", "lang_pred", "score"])

    rows = docs.select(F.struct(*keep or (F.col(id_col).cast("long").alias("doc_id"),)).alias("k"), F.col(text_col).alias("t"))
    shape = rows.select("k", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, shape).select("k.*", "lang_pred", "score")


def reject_unknown(docs: DataFrame, model: Model | None, over_chance: float = 1.1, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have no language: no letter at all, or no language whose mean probability
    is ``over_chance`` times that of a guess among the model's languages. Same columns; all else stays: repeated rows,
    null ids, long texts. Null and empty texts have no letter and go; without a model all go; an empty table stays
    empty."""
    least = over_chance / len(model.labels) if model and len(model.labels) > 1 else 0.0
    found = identify(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col(text_col).alias("t_")), model, text_col="t_", keep=("d",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("d.*")
