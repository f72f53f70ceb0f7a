"""Language identification by hierarchical discrimination.

A text goes to a language family first: one linear support vector machine per pair of families
votes. Inside the family, one machine per pair of languages separates the close relatives. Features
are hashed counts of the 1- to 3-byte runs of the lower-cased text, square-rooted and scaled to
length one. Every text is read whole.

Decisions: a text that is null or has no letter is ``und`` with score 0. Any text repeated gives the
same answer. A training table with one language predicts it everywhere; with none, all is ``und``.
Training rows without text, language or id are left out. Ties between languages go to the first name.
Every language of the training table is learnt: the more there are, the fewer texts of each are taken, so that about
``TRAIN_ROWS`` come to the driver in all, and beyond ``MOST_FAMILIES`` families those of one language are dealt into groups of
alike ones, which vote as families do.

Machines always name one of the learnt languages. How far a text is like any of them at all is a second figure: the greatest
cosine with a language's mean text, over the least that a training text of about its length has with its own language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import left_join_unique
from .common import map_batches, release_memory, texts_of
from .hashed import byte_ngrams

#: Families of the languages often met; any other code is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
UNDETERMINED = "und"
BUCKETS = (256, 1024, 4096)

#: Bound of the fit: about so many training texts of each language, and in all (at least one of each language).
TRAIN_PER_LANGUAGE = 800
TRAIN_ROWS = 8000
#: Lengths are told apart by their power of two up to this one.
LENGTHS = 24
#: More families than this are joined to groups, so that machines grow slower than the square of the languages.
MOST_FAMILIES = 64


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, members in FAMILIES.items() if base in members), f"only-{base}")


def features(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    x = np.concatenate([byte_ngrams(data, k + 1, b) for k, b in enumerate(BUCKETS)]).astype(np.float32)
    np.sqrt(x, out=x)
    norm = float(np.sqrt(x @ x))
    return x / np.float32(norm) if norm else x


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train_machine(
    x: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 10.0
) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by dual coordinate descent on ``x[rows]``; y is +1 or -1."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(7)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    alpha, ridge = np.zeros(n), 1 / (2 * c * weight)
    diagonal = np.array([x[r] @ x[r] for r in rows]) + 1 + ridge
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            xi = x[rows[i]]
            g = y[i] * (float(xi @ w) + b) - 1 + ridge[i] * alpha[i]
            step = max(alpha[i] - g / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * xi
                b += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _size_class(chars: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(chars, 1)).astype(np.int64), LENGTHS - 1)


class Discriminator:
    """All machines as one weight matrix, so a batch of texts is one matrix product."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self._group({x: family_of(x) for x in self.langs})
        self.pairs: list[tuple[str, str]] = []
        self.weights = np.zeros((0, sum(BUCKETS)), dtype=np.float32)
        self.bias = np.zeros(0, dtype=np.float32)
        self.means = np.zeros((0, sum(BUCKETS)), dtype=np.float32)
        self.least = np.ones(LENGTHS)

    def _group(self, family: dict[str, str]) -> None:
        self.family = family
        self.families = sorted(set(family.values()))
        self.members = {f: [x for x in self.langs if family[x] == f] for f in self.families}

    def _join_single_families(self, x: np.ndarray, lang: np.ndarray) -> None:
        """Deals the languages that are alone in their family into groups along the main axis of their mean texts."""
        alone = [m[0] for m in self.members.values() if len(m) == 1]
        means = np.stack([x[lang == v].mean(axis=0) for v in alone])
        axis = np.linalg.svd(means - means.mean(axis=0), full_matrices=False)[2][0]
        order = [alone[i] for i in np.argsort(means @ axis, kind="stable")]
        size = int(np.ceil(np.sqrt(len(order))))
        self._group(self.family | {v: f"group-{i // size}" for i, v in enumerate(order)})

    def fit(self, x: np.ndarray, lang: np.ndarray, chars: np.ndarray | None = None) -> Discriminator:
        if len(self.families) > MOST_FAMILIES:
            self._join_single_families(x, lang)
        family = np.array([self.family[v] for v in lang])
        weights, bias = [], []
        for names, marks in [(self.families, family), *((m, lang) for m in self.members.values())]:
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    rows = np.flatnonzero((marks == a) | (marks == b))
                    w, c = train_machine(x, rows, np.where(marks[rows] == a, 1.0, -1.0))
                    self.pairs.append((a, b))
                    weights.append(w)
                    bias.append(c)
        if weights:
            self.weights = np.array(weights, dtype=np.float32)
            self.bias = np.array(bias, dtype=np.float32)
        self._fit_likeness(x, lang, np.full(len(x), 1 << LENGTHS) if chars is None else chars)
        return self

    def _fit_likeness(self, x: np.ndarray, lang: np.ndarray, chars: np.ndarray) -> None:
        """Mean texts, and for each power of two the least cosine of a training text at least that long with its own mean."""
        means = np.stack([x[lang == v].mean(axis=0) for v in self.langs])
        norms = np.linalg.norm(means, axis=1, keepdims=True)
        self.means = (means / np.where(norms > 0, norms, 1)).astype(np.float32)
        own = np.einsum("ij,ij->i", x, self.means[np.searchsorted(self.langs, lang)])
        size = _size_class(chars)
        for k in range(LENGTHS):
            near = own[size == k]
            # a length that was not seen is judged as the next shorter one
            self.least[k] = near.min() if len(near) else self.least[k - 1] if k else 0.0

    def familiarity(self, x: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Cosine with the nearest language over the least one learnt for texts of this length; 1 and more is usual."""
        return (x @ self.means.T).max(axis=1) / np.maximum(self.least[_size_class(chars)], 1e-6)

    def _vote(self, names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with most won pairs, then the largest smallest margin; its logistic confidence."""
        best = (-1, 0.0, "")
        for name in reversed(names):
            own = [m if a == name else -m for (a, b), m in margins.items() if name in (a, b) and {a, b} <= set(names)]
            won, least = sum(v > 0 for v in own), min(own, default=10.0)
            if (won, least) >= best[:2]:
                best = (won, least, name)
        return best[2], 1 / (1 + float(np.exp(-4 * min(max(best[1], -10.0), 10.0))))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        scores = x @ self.weights.T + self.bias
        out = []
        for row in scores:
            margins = dict(zip(self.pairs, row.tolist(), strict=True))
            family, sure = self._vote(self.families, margins)
            lang, surer = self._vote(self.members[family], margins)
            out.append((lang, min(sure, surer)))
        return out


def fit(train: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Discriminator:
    """Learns from a bounded sample of ``train`` (doc_id, text, lang).

    The sample's features (about ``per_language`` rows a language) come to the driver, where the pairwise
    machines are fitted; nothing else does. Rows are chosen by a hash of their id and text.
    """
    known = train.where("doc_id is not null and lang is not null and text is not null")
    n_langs = known.select("lang").distinct().count()
    if not n_langs:
        return Discriminator([])
    per_language = max(1, min(per_language, TRAIN_ROWS // n_langs))
    drawn = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 20))
    # one of each language stays, whatever its rows hash to
    least = known.groupBy("lang").agg(F.count(F.lit(1)).alias("of"), F.min(drawn).alias("least"))
    cut = F.least(F.lit(1 << 20), F.floor(F.lit((1 << 20) * per_language) / F.col("of")) + 1)
    limits = least.select("lang", F.greatest(cut, F.col("least") + 1).alias("cut"))
    picked = left_join_unique(known.withColumn("drawn", drawn), limits, ["lang"]).where("drawn < cut").select("text", "lang")

    def work(batch):
        texts = texts_of(batch.column(0))
        vectors = [features(t).astype(np.float16).tobytes() for t in texts]
        return {"lang": batch.column(1), "chars": [len(t) for t in texts], "x": vectors}

    # the hash leaves about the bound; the limit only guards the driver against one row repeated for ever
    rows = (
        map_batches(picked, work, "lang string, chars long, x binary")
        .limit(2 * per_language * n_langs + 1000)
        .toPandas()
        .sort_values(["lang", "x"])
    )
    x = np.stack([np.frombuffer(v, dtype=np.float16) for v in rows["x"]]).astype(np.float32)
    return Discriminator(sorted(set(rows["lang"]))).fit(x, rows["lang"].to_numpy(), rows["chars"].to_numpy())


def identify(docs: DataFrame, model: Discriminator) -> DataFrame:
    """``docs`` with lang_pred, score and familiarity of every text in a column ``found``; only texts go to the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of fixed width

    @F.pandas_udf("lang_pred string, score double, familiarity double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            langs, scores, alike = [UNDETERMINED] * len(texts), [0.0] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and model.langs and has_letter(t)]
            for low in range(0, len(rows), 128):
                part = rows[low : low + 128]
                x = np.stack([features(texts.iloc[i]) for i in part])
                got = model.predict(x)
                alike[part] = model.familiarity(x, np.array([len(texts.iloc[i]) for i in part]))
                for i, (lang, score) in zip(part, got, strict=True):
                    langs[i], scores[i] = lang, score
            texts = None
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "familiarity": alike})
        release_memory()

    return docs.withColumn("found", found(F.col("text")))
