"""Toxicity scores from subword bags: character n-gram vectors averaged into a linear softmax, trained jointly.

A text's distinct words, in order of their first use, are read in overlapping windows; each window is the mean of the
vectors of its words' character n-grams, and its softmax score is linear in that mean. The text scores as its highest window, in training too, so a
few bad words count in a text of any length. N-grams share hashed buckets, so unseen spellings share most vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice

#: Characters of an n-gram (a space marks a word's edge), buckets, size of a vector, words of a window and of a step.
NGRAMS, BUCKETS, DIM, WINDOW, STEP = (3, 4, 5, 6), 1 << 17, 8, 32, 16
#: Characters cut off both ends of a word that has others.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¡¿"
#: The documented sample: labelled rows of each class, by least hash of doc_id.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1000, 2000
#: Characters beyond which a labelled text is not taken into the sample, so that its size is bounded in bytes too.
SAMPLE_CHARS = 50_000
EPOCHS, BATCH, RATE, SEED = 30, 32, 0.15, 7
#: Every so manieth text of the sample is kept from training, to set the scale and offset of the logits.
CALIBRATION = 5


class Bags:
    """The n-grams of several texts by distinct word, and the words by window; so a word said a hundred times weighs as one."""

    def __init__(self, texts: list[str]):
        words = [list(dict.fromkeys(w.strip(EDGES) or w for w in t.lower().split())) for t in texts]
        self.words = np.array([len(w) for w in words], np.int64)
        joined = " " + " ".join(" ".join(w) for w in words if w) + " "
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.space = self.code == 32
        self.word_at = np.cumsum(self.space) - 1  # a space belongs to the word after it
        self.n_words = int(self.words.sum())

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of each n-gram: within a word and its edges."""
        m = len(self.code) - n + 1
        if m <= 0 or not self.n_words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= ~self.space[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint32)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ self.code[at + k]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
        return self.word_at[at + 1], ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end word) of each window; texts without words have none."""
        n = np.where(self.words > 0, np.maximum(-(-(self.words - WINDOW) // STEP), 0) + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.cumsum(self.words) - self.words
        a = first[text] + nth * STEP
        return text, a, np.minimum(a + WINDOW, first[text] + self.words[text])


@dataclass
class Model:
    """``weight`` of each bucket is its vector times the softmax's direction; ``bias`` the rest of the logit."""

    weight: np.ndarray
    bias: float
    loss: list[float] = field(default_factory=list)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))

    def logits(self, texts: list[str]) -> np.ndarray:
        bags = Bags(texts)
        total, count = np.zeros(bags.n_words + 1), np.zeros(bags.n_words + 1)
        for n in NGRAMS:
            word, bucket = bags.grams(n)
            total[1:] += np.bincount(word, weights=self.weight[bucket], minlength=bags.n_words)
            count[1:] += np.bincount(word, minlength=bags.n_words)
        total, count = np.cumsum(total), np.cumsum(count)
        text, a, b = bags.windows()
        logit = (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        best[~np.isfinite(best)] = 0.0  # no words: an empty bag
        return best + self.bias


def _bags_of(texts: list[str], step: int = 200) -> tuple[np.ndarray, ...]:
    """(bucket of each n-gram by word, n-grams before each word, text, first word and end word of each window)."""
    buckets, counts, windows, words = [], [], [], 0
    for k in range(0, len(texts), step):
        bags = Bags(texts[k : k + step])
        pairs = [bags.grams(n) for n in NGRAMS]
        word = np.concatenate([w for w, _ in pairs])
        buckets.append(np.concatenate([b for _, b in pairs])[np.argsort(word, kind="stable")].astype(np.int32))
        counts.append(np.bincount(word, minlength=bags.n_words))
        text, a, b = bags.windows()
        windows.append((text + k, a + words, b + words))
        words += bags.n_words
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), *(np.concatenate(x) for x in zip(*windows))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train vectors and softmax together by AdaGrad; of each text the window that scores highest is learned from.

    Without texts of both labels every text scores as the share of label 1 (0 without any)."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    bucket, edge, text, a, b = _bags_of(texts)
    if not len(text):
        return fit([], [])
    vec = rng.normal(0, 0.05, (BUCKETS, DIM))
    out = rng.normal(0, 0.3, (DIM, 2))
    bias = np.zeros(2)
    grad_v, grad_o, grad_b = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    has = text[first]
    loss = []
    for _ in range(epochs):
        score = (vec @ (out[:, 1] - out[:, 0])).astype(np.float32)
        flat = np.concatenate([[0.0], np.cumsum(np.add.reduceat(score[bucket], edge[:-1]), dtype=np.float64)])
        logit = (flat[b] - flat[a]) / np.maximum(edge[b] - edge[a], 1)
        pick = np.array([f + int(np.argmax(logit[f:g])) for f, g in zip(first, [*first[1:], len(text)])])
        total = 0.0
        for part in np.array_split(rng.permutation(len(has)), max(1, len(has) // BATCH)):
            w, goal = pick[part], y[has[part]]
            size = edge[b[w]] - edge[a[w]]
            ids = bucket[np.repeat(edge[a[w]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            row = np.repeat(np.arange(len(w)), size)
            mean = np.zeros((len(w), DIM))
            np.add.at(mean, row, vec[ids])
            mean /= np.maximum(size, 1)[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = p.copy()
            d[np.arange(len(w)), goal] -= 1
            total -= np.log(p[np.arange(len(w)), goal] + 1e-12).sum()
            g_out, g_bias, g_mean = mean.T @ d / len(w), d.mean(axis=0), d @ out.T
            used, inverse = np.unique(ids, return_inverse=True)
            g_vec = np.zeros((len(used), DIM))
            np.add.at(g_vec, inverse, (g_mean / np.maximum(size, 1)[:, None])[row])
            grad_v[used] += (g_vec**2).mean(axis=1)
            vec[used] -= RATE * g_vec / np.sqrt(grad_v[used])[:, None]
            grad_o += g_out**2
            grad_b += g_bias**2
            out -= RATE * g_out / np.sqrt(grad_o)
            bias -= RATE * g_bias / np.sqrt(grad_b)
        loss.append(total / len(has))
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), loss)


def fit_calibrated(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """:func:`fit` on four fifths of the texts, then scale and offset by logistic regression on the other fifth, as if
    label 1 had the given share. Where either part lacks a label, the plain fit on all texts."""
    parts = [[(t, y) for k, (t, y) in enumerate(zip(texts, labels)) if (k % CALIBRATION == 0) == held] for held in (False, True)]
    if any(len({y for _, y in p}) < 2 for p in parts):
        return fit(texts, labels)
    model = fit(*map(list, zip(*parts[0])))
    x, y = model.logits([t for t, _ in parts[1]]), np.array([y for _, y in parts[1]], float)
    weight = np.ones_like(y) if share is None else np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    unit = float(x.std()) or 1.0
    design, prior = np.stack([x / unit, np.ones_like(x)], axis=1), np.array([1.0, 0.0])

    def loss(theta: np.ndarray) -> float:  # a weak pull to scale 1 and offset 0 keeps separable parts finite
        z = design @ theta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.1 * ((theta - prior) ** 2).sum())

    theta = prior
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -60, 60)))
        grad = design.T @ (weight * (p - y)) + 0.2 * (theta - prior)
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.2 * np.eye(2), grad)
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
    scale = max(float(theta[0]), 1e-3) / unit
    return Model(model.weight * scale, model.bias * scale + float(theta[1]), model.loss)


def fit_labelled(docs: DataFrame, labels: DataFrame, positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE) -> Model:
    """Fit on ``docs(doc_id, text)`` labelled by ``labels(doc_id, toxic)``; null labels and texts teach nothing.

    Of several labels of a document the greater counts, of several texts the least.

    The sample is bounded and documented: about ``positive`` and ``negative`` rows, those with the least hash of
    doc_id; their whole texts are used. Labelled texts of more than ``SAMPLE_CHARS`` characters are not in it. All texts are scored whole."""
    rows = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    share = F.when(F.col("toxic") == 1, positive / max(1, counts.get(1, 0))).otherwise(negative / max(1, counts.get(0, 0)))
    sample = rows.where(place <= share)  # about positive + negative ids: small enough to broadcast at any size
    matched = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null").where(F.char_length("text") <= SAMPLE_CHARS)
    found = matched.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit_calibrated([r["text"] for r in found], [r["toxic"] for r in found], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, score)``, one row for each row.

    Null and empty texts score as an empty bag; repeated rows get equal scores; other columns are ignored; null ids
    are carried; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(texts))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(per_slice(run), "doc_id long, score double")
