"""Quality classifier: nearest labelled neighbours vote in a latent semantic space.

Terms of a text are hashed byte trigrams, single bytes, n-grams of its character shape (letters, capitals,
digits and blanks each as one class, other characters as themselves) and a few marks of structure
(repeated neighbouring words, repeated lines, length). Term counts are damped, weighted by
inverse document frequency and projected on the leading singular vectors of the labelled sample. The
sample's vectors are broadcast; every document is compared with all of them by blocked matrix products,
and the nearest vote with the power of their cosine.

Decisions: every text is read whole. An empty or null text, or one without any neighbour of positive cosine,
gets the sample's share of label 1. Several labels of one id count by their mean; null labels and ids
are left out. Ties between neighbours (cosines equal to six digits) go to the earlier row of the sample, which is sorted by
its terms. Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .hashed import byte_ngrams

#: Bound of the fit: about so many labelled rows are learnt from; their vectors are what is broadcast.
SAMPLE_ROWS = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
POWER = 4
#: Cosines that agree to so many digits are ties: equal vectors may differ in their last bits.
DIGITS = 6
THRESHOLD = 0.3

TRIGRAMS, SHAPES, MARKS = 2048, 512, 40


def _shape_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[128:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


_SHAPE = _shape_table()


def _marks(text: str) -> np.ndarray:
    """Shares of structure in tenths: a term for each tenth that is reached."""
    out = np.zeros(MARKS, dtype=np.int64)
    words = text.split()
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (again / n, (len(lines) - len(set(lines))) / max(1, len(lines)), (n - len(set(words))) / n)
    for k, share in enumerate(shares):
        out[10 * k : 10 * k + min(10, int(10 * share))] = 8
    out[30 + min(9, len(words).bit_length() * 9 // 20)] = 8
    return out


def terms(text: str) -> np.ndarray:
    """Damped counts of all terms of a text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    shape = _SHAPE[data]
    runs = shape[np.flatnonzero(np.concatenate(([True], shape[1:] != shape[:-1])))] if len(shape) else shape
    counts = np.concatenate(
        [
            byte_ngrams(data, 3, TRIGRAMS),
            np.bincount(shape, minlength=256),
            byte_ngrams(runs, 2, SHAPES),
            byte_ngrams(runs, 4, SHAPES),
            _marks(text),
        ]
    )
    return np.log1p(counts.astype(np.float32))


class NeighbourVote:
    def __init__(self):
        self.idf = self.axes = self.vectors = None
        self.labels = np.zeros(0, dtype=np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS) -> NeighbourVote:
        self.labels = y.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = self._scaled(x)
        rng = np.random.default_rng(11)
        k = min(dimensions, *x.shape)
        basis = rng.standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
        for _ in range(6):  # power rounds of a randomised singular value decomposition
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = (basis @ v.T[:, :k]).astype(np.float32)
        self.vectors = self.project(x, scaled=True)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        x = x * self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def project(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        z = (x if scaled else self._scaled(x)) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return (z / np.where(norm > 0, norm, 1)).astype(np.float32)

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        """Scores of a block of texts against all labelled vectors."""
        cosine = np.maximum(np.round(self.project(x) @ self.vectors.T, DIGITS), 0)
        k = min(neighbours, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
        above, equal = cosine > last, cosine == last
        # of those equal to the last neighbour the earliest rows are taken
        near = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(near, cosine, 0).astype(np.float64) ** power
        total = weight.sum(axis=1)
        vote = weight @ self.labels.astype(np.float64)
        return np.clip(np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> NeighbourVote:
    """Learns from about ``sample_rows`` labelled rows, chosen by a hash of their id.

    Only the sample's term counts come to the driver.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
    )
    n = known.count()
    cut = min(1 << 20, int((1 << 20) * sample_rows / max(1, n)) + 1)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut)
    # about sample_rows rows of two numbers: bounded, so it may be broadcast
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def work(batch):
        texts = texts_of(batch.column(0))
        return {"quality": batch.column(1), "x": [terms(t).astype(np.float16).tobytes() for t in texts]}

    got = (
        map_batches(rows.select("text", "quality"), work, "quality double, x binary")
        .limit(2 * sample_rows + 1000)  # guards the driver against an id that repeats for ever
        .toPandas()
        .sort_values(["x", "quality"])
    )
    if not len(got):
        return NeighbourVote()
    x = np.stack([np.frombuffer(v, dtype=np.float16) for v in got["x"]]).astype(np.float32)
    return NeighbourVote().fit(x, got["quality"].to_numpy())


def score(docs: DataFrame, model: NeighbourVote, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if the score reaches the threshold) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size

    def work(batch):
        model = shared.value
        texts = texts_of(batch.column(1))
        scores = np.full(len(texts), model.prior)
        rows = [i for i, t in enumerate(texts) if t and len(model.labels)]
        for low in range(0, len(rows), 128):
            part = rows[low : low + 128]
            scores[part] = model.score(np.stack([terms(texts[i]) for i in part]))
        return {"doc_id": batch.column(0), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, score double, predicted int")
