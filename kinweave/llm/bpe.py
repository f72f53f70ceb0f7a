"""Byte-pair encoding and decoding with an index of pair occurrences.

All distinct words of a batch of texts lie in one array of symbols, linked to their neighbours.
An index maps every mergeable pair (by its rank) to all its positions in the array. Active ranks
are taken in ascending order; each merges all its positions at once, and only the pairs beside them are looked up
and entered again. Words met before in the task are not encoded again.

Decisions: a null text is empty and has no token. Strings of added tokens inside a text get the added token's id, as the
tokenizers library does by default. Decoding joins the bytes of the tokens and reads them as UTF-8, with the
replacement character for bytes that are none. The vocabulary file is a parameter (a path on every node).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches
from .units import WORDS, byte_letters, forget, pieces

#: Symbols merged together at once: bounds the work arrays.
BLOCK_SYMBOLS = 1 << 21


class Vocabulary:
    """Merges, byte symbols and token bytes of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model, letters = found["model"], byte_letters()
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in found["added_tokens"])])
        self.code = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.symbol_of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.symbol_of_byte[b] = ids[letter]
        self.added = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            if token not in self.added:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is not mergeable."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)


class PairIndex:
    """Mergeable pairs of an array of symbols, by rank, with all their positions."""

    def __init__(self):
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
            if rank in self.positions:
                self.positions[rank].append(part)
            else:
                self.positions[rank] = [part]
                heapq.heappush(self.active, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        return rank, np.unique(np.concatenate(self.positions.pop(rank)))


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """The token ids of each word (of at least one byte), as packed integers of the vocabulary's width."""
    if not words:
        return []
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(data)
    # one place more on each side, so that a missing neighbour is an ordinary place without a symbol
    sym = np.full(n + 1, -1, dtype=np.int64)
    sym[:n] = vocab.symbol_of_byte[data]
    ends = np.cumsum(lengths)
    after = np.arange(1, n + 2, dtype=np.int64)
    before = np.arange(-1, n, dtype=np.int64)
    after[ends - 1] = n
    before[(ends - lengths)] = n
    index = PairIndex()
    places = np.arange(n)
    has = after[:n] < n
    index.add(vocab.ranks(sym[:n][has], sym[after[:n][has]]), places[has])
    while index.active:
        rank, at = index.pop()
        left, right = vocab.left[rank], vocab.right[rank]
        at = at[(sym[at] == left) & (sym[after[at]] == right)]
        if left == right and len(at) > 1:
            at = _apart(at, after)
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        sym[at], sym[gone] = vocab.merged[rank], -1
        after[at] = follow
        inside = follow < n
        before[follow[inside]] = at[inside]
        start = np.concatenate([before[at], at])
        start = start[start < n]
        start = np.unique(start[after[start] < n])
        index.add(vocab.ranks(sym[start], sym[after[start]]), start)
    alive = sym[:n] >= 0
    tokens = sym[:n][alive].astype(vocab.code)
    counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
    upto = (np.cumsum(counts) * tokens.itemsize).tolist()
    packed = tokens.tobytes()
    return [packed[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of a run of overlapping positions every other one, from the left."""
    kept, taken = [], -1
    for p in at.tolist():
        if p != taken:
            kept.append(p)
            taken = int(after[p])
    return np.array(kept, dtype=np.int64)


class Encoder:
    """Encodes texts batch by batch; distinct pieces and words are merged once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, bytes] = {}
        self.added = {t: np.array([i], dtype=vocab.code).tobytes() for t, i in vocab.added.items()}

    def _parts(self, text: str) -> list[str]:
        if not any(t in text for t in self.added):
            return pieces(text)
        import re

        # an added token is a part of its own; what stands between is cut as usual
        out = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text):
            out += [part] if part in self.added else pieces(part)
        return out

    def _learn(self, parts: set[str]) -> None:
        new = list(parts)
        split = [WORDS.findall(p) for p in new]
        words = sorted({w for ws in split for w in ws})
        codes: dict[str, bytes] = {}
        low = size = 0
        raw = [w.encode("utf-8", "replace") for w in words]
        for k, w in enumerate([*raw, None]):
            if w is None or size > BLOCK_SYMBOLS:
                codes.update(zip(words[low:k], merge_words(raw[low:k], self.vocab), strict=True))
                low, size = k, 0
            size += len(w or b"")
        for p, ws in zip(new, split, strict=True):
            self.known[p] = codes[ws[0]] if len(ws) == 1 else b"".join(codes[w] for w in ws)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.known = forget(self.known)
        self.known.update(self.added)
        parts = [self._parts(t) for t in texts]
        fresh: set[str] = set()
        for p in parts:
            fresh.update(filterfalse(self.known.__contains__, p))
        self._learn(fresh)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), dtype=self.vocab.code) for p in parts]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    return b"".join(map(vocab.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Vocabulary(path))
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text; no shuffle."""

    def work(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "ids": [x.astype(np.int32) for x in encoder(path).encode(texts)]}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids)."""

    def work(batch):
        vocab = encoder(path).vocab
        return {
            "doc_id": batch.column(0),
            "text": [decode(np.array(x or [], dtype=np.int64), vocab) for x in batch.column(1).to_pylist()],
        }

    return map_batches(coded.select("doc_id", "ids"), work, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts encoded, and decoded again from the ids."""

    def work(batch):
        own = encoder(path)
        names = [str(i) for i in range(own.vocab.size)]
        texts = [t or "" for t in batch.column(1).to_pylist()]
        coded = own.encode(texts)
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) for x in coded],
            "ids_sha256": [
                hashlib.sha256(",".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in coded
            ],
            "decoded_sha256": [
                hashlib.sha256(decode(x, own.vocab).encode("utf-8", "replace")).hexdigest() for x in coded
            ],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), work, schema)
