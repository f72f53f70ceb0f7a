"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text's elements are its runs of five words (lower-cased, split at white space) with the number of their
occurrences as weights. Each element sends arrivals of a Poisson process whose rate is its weight; every arrival
falls on one of 80 registers, which keeps the element that came first. Elements stop as soon as their next arrival is
later than the text's last register (early termination), so long texts cost about one arrival for an element. Two
registers agree with a probability that is the probability Jaccard similarity of the weighted elements.
Registers are banded by four; texts that share a band are candidates, and a candidate is linked if its exact
probability Jaccard is 0.8 or more. At 0.8 a pair misses all 20 bands about once in 40,000.

Classes are the connected components of the links. Equal texts are one node. In each bucket all texts are first
compared with one hub; then the buckets whose texts are still in different components are cut into tiles of bounded size.
A first pass over the tiles compares registers only and names the texts that may still have a link there; a pair is looked at
in the first bucket it shares only, and buckets of the same texts are taken once. A second pass measures these texts by
matrix products, and only links that join components leave a tile. So a large group of copies costs a star and some tiles
and not a list of all its pairs, and no link that could join two classes is left out. Nothing is capped.

Decisions: a text of fewer than five words has one element of all its words. Equal texts are one class, empty and
null ones too; other texts without a word are linked to nothing. ``class_id`` is the least id of the class (null only if
all its ids are). Rows are not merged: each gets its class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import connected_components, join_components
from ..operators.skew import left_join_unique
from ..session import broadcast_if_small, scratch, stage, unstage
from .common import WordHashes, arrow_rows, arrow_schema, as_batch, map_batches, mix64, release_memory, shuffle_partitions, text_slices, word_windows

WORDS_IN_ELEMENT = 5
SIMILARITY = 0.8
REGISTERS = 80
BAND_ROWS = 4
#: Candidates whose registers agree in a smaller share are not compared (0.2 below is 4.5 standard errors).
SLACK = 0.2

_U = np.uint64
_TIME, _PLACE = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93  # fixed values: streams of a mixed counter
_WRAP = (1 << 64) - 1


def elements(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element hash, weight), sorted by both, over all texts."""
    runs = [word_windows(hashes(t.lower().split()), WORDS_IN_ELEMENT) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
    h = np.concatenate(runs) if runs else np.zeros(0, dtype=_U)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(at, append=len(h)).astype(np.float64)


def registers(of: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, size: int = REGISTERS) -> np.ndarray:
    """The element hash in each register of each of ``n`` texts (0 where a text has none)."""
    best = np.full(n * size, np.inf)
    owner = np.zeros(n * size, dtype=_U)
    time = np.zeros(len(h))
    k = 0
    while len(h):
        k += 1
        u = ((mix64(h + _U(k * _TIME & _WRAP)) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / weight
        place = (mix64(h ^ _U(k * _PLACE & _WRAP)) % _U(size)).astype(np.int64) + of * size
        np.minimum.at(best, place, time)
        first = best[place] == time
        owner[place[first]] = h[first]
        # early termination: a later arrival of an element cannot be the first in any register
        last = best.reshape(n, size).max(axis=1)
        on = time < last[of]
        of, h, weight, time = of[on], h[on], weight[on], time[on]
    return owner.reshape(n, size)


def band_keys(owner: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band of each text; the band's number is part of it."""
    n, size = owner.shape
    parts = owner.reshape(n, size // rows, rows)
    key = np.broadcast_to(np.arange(size // rows, dtype=_U), (n, size // rows)).copy()
    for k in range(rows):
        key = mix64(key ^ parts[:, :, k])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets, each (sorted hashes, weights).

    The sum over the common elements i of 1 / sum over all j of max(a_j / a_i, b_j / b_i), by sorting
    the elements by b_j / a_j.
    """
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    x, y = wa[ia], wb[ib]
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto_x, upto_y = np.cumsum(x), np.cumsum(y)
    # elements of equal ratio count on the first side for each other
    last = np.searchsorted(ratio, ratio, side="right") - 1
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below = only_a + upto_x[last]
    above = only_b + (y.sum() - upto_y[last])
    return float((1.0 / (below / x + above / y)).sum())


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, node (128 bits of the text), chars, bands and registers (32 bits each); one pass, no shuffle."""

    def work(batch):
        import hashlib

        texts = [t or "" for t in batch.column(1).to_pylist()]
        hashes = WordHashes()
        for low, high in text_slices(texts, 1 << 20):
            part = texts[low:high]
            of, h, w = elements(part, hashes)
            owner = registers(of, h, w, len(part))
            some = np.bincount(of, minlength=len(part)) > 0
            keys = band_keys(owner)
            short = (owner & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield {
                "doc_id": batch.column(0)[low:high],
                "node": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in part],
                "chars": [len(t) for t in part],
                "bands": [k.tolist() if s else [] for k, s in zip(keys, some, strict=True)],
                "registers": [r.tolist() if s else [] for r, s in zip(short, some, strict=True)],
            }

    schema = "doc_id long, node binary, chars long, bands array<long>, registers array<int>"
    return map_batches(docs.select("doc_id", "text"), work, schema)


def _node() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _agreeing(a: Column, b: Column) -> Column:
    """Number of registers that agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


class _Texts:
    """Texts of the nodes that have candidates, fetched once a node."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes

    def of(self, some: DataFrame) -> DataFrame:
        """(node, text) of the given nodes, each once, as a table."""
        wanted = stage(self.nodes.select("node", "first_id").join(some, "node"), "wanted")
        read = self.docs.select(F.col("doc_id").alias("_id"), "text")
        # an id may be given to several texts, so the text must be the one that is meant
        met = read.join(broadcast_if_small(wanted), F.col("first_id").eqNullSafe(F.col("_id")))
        met = met.where(F.col("node") == _node()).select("node", F.coalesce("text", F.lit("")).alias("text"))
        found = stage(met.dropDuplicates(["node"]), "candidate-texts")
        unstage(wanted)
        return found

    def verified(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """The pairs (a, b) whose exact similarity reaches ``similarity``."""
        both = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        texts = self.of(both)
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

        def work(batch):
            hashes, known = WordHashes(), {}

            def weighted(node: bytes, text: str):
                if node not in known:
                    if len(known) > 64:
                        known.clear()
                    known[node] = elements([text], hashes)[1:]
                return known[node]

            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            ok = [
                probability_jaccard(weighted(x, s), weighted(y, t)) >= similarity - 1e-9
                for x, y, s, t in zip(a, b, text_a, text_b, strict=True)
            ]
            return {
                "a": [x for x, k in zip(a, ok, strict=True) if k],
                "b": [x for x, k in zip(b, ok, strict=True) if k],
            }

        found = stage(map_batches(rows, work, "a binary, b binary"), "links")
        unstage(texts)
        return found


def _shared_columns(h: np.ndarray, of: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each element a column number if texts of two parts hold it, else -1."""
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    p = part[of[order]]
    both = np.minimum.reduceat(p, at) != np.maximum.reduceat(p, at)
    column = np.where(both, np.cumsum(both) - 1, -1)
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.repeat(column, np.diff(at, append=len(h)))
    return out


def tile_links(
    texts: list[str], part: np.ndarray, side: np.ndarray | None, similarity: float, columns: int = 2048
) -> list[tuple[int, int]]:
    """Links between different parts among the texts of a tile, enough to join all parts that any link joins.

    Common mass of all pairs comes from blocked matrix products; only pairs that can reach the similarity and are
    still in different parts get the exact measure. With ``side``, only pairs of different sides count.
    """
    m = len(texts)
    of, h, w = elements(texts, WordHashes())
    own = [(h[a:b], w[a:b]) for a, b in zip(*(np.searchsorted(of, np.arange(m) + k) for k in (0, 1)), strict=True)]
    total = np.bincount(of, weights=w, minlength=m)
    column = _shared_columns(h, of, part) if len(h) else h.astype(np.int64)
    common = np.zeros((m, m), dtype=np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, columns):
        here = (column >= low) & (column < low + columns)
        mass = np.zeros((m, columns), dtype=np.float32)
        mass[of[here], column[here] - low] = w[here] / total[of[here]]
        common += mass @ (mass > 0).astype(np.float32).T
    able = np.minimum(common, common.T)  # a bound of the similarity
    single = np.array([(x[1] == 1).all() for x in own])
    shared = common * total[:, None]
    exact = shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-9)
    able = np.where(single[:, None] & single[None, :], exact, able)  # of unweighted texts the similarity itself
    able[np.tril_indices(m)] = 0
    able[part[:, None] == part[None, :]] = 0
    if side is not None:
        able[side[:, None] == side[None, :]] = 0
    x, y = np.nonzero(able >= similarity - 1e-4)
    root = np.arange(int(part.max(initial=-1)) + 1)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for k in np.argsort(-able[x, y], kind="stable").tolist():
        i, j = int(x[k]), int(y[k])
        p, q = find(part[i]), find(part[j])
        if p != q and probability_jaccard(own[i], own[j]) >= similarity - 1e-9:
            root[p] = q
            out.append((i, j))
    return out


#: Texts and characters of one block of a bucket; a tile holds two blocks at most.
BLOCK_TEXTS, BLOCK_CHARS = 512, 1 << 22
_TILE = ["key", "low", "high"]


def _by_tile(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows (as tuples) of one tile after the other; it gives columns by name."""
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(n, *_TILE).sortWithinPartitions(*_TILE)
    fields = arrow_schema(schema)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield as_batch(work(held), fields)
                    held = []
                held.append(row)
        if held:
            yield as_batch(work(held), fields)
        release_memory()

    return dealt.mapInArrow(run, schema)


def _sides(held: list[tuple], block: int) -> np.ndarray | None:
    """The block of each row of a tile of two blocks; None in a tile of one."""
    return np.array([r[block] for r in held]) if held[0][1] != held[0][2] else None


def likely_members(
    bands: np.ndarray, owner: np.ndarray, part: np.ndarray, side: np.ndarray | None, band: int, least: int
) -> np.ndarray:
    """Which texts of a tile have a partner in another part with ``least`` equal registers, and share no earlier band than ``band``."""
    m = len(part)
    able = part[:, None] != part[None, :]
    if side is not None:
        able &= side[:, None] != side[None, :]
    for k in range(band):  # a pair that shares an earlier band is looked at there
        able &= bands[:, k][:, None] != bands[:, k][None, :]
    if able.any():
        equal = np.zeros((m, m), dtype=np.int16)
        for k in range(owner.shape[1]):
            equal += owner[:, k][:, None] == owner[:, k][None, :]
        able &= equal >= least
    return able.any(axis=0) | able.any(axis=1)


def _rest(members: DataFrame, parts: DataFrame, nodes: DataFrame, texts: _Texts, similarity: float) -> DataFrame | None:
    """Links inside buckets whose texts are still in several components, or None if there can be none.

    A bucket is cut into blocks; each pair of blocks is a tile, and a task sees one tile at a time. All pairs
    of different components are looked at, but only links that join components leave the tile.
    """
    placed = members.join(parts, "node", "left").select("key", "band", "node", "chars", F.coalesce("component", "node").alias("part"))
    mark = F.xxhash64("node")
    mixed = placed.groupBy("key").agg(
        F.min("part").alias("least"),
        F.max("part").alias("most"),
        F.first("band").alias("band"),
        F.count(F.lit(1)).alias("n"),
        F.sum("chars").alias("chars"),
        F.bit_xor(mark).alias("_x"),
        F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("_y"),
    )
    # buckets of the same texts are taken once, in the first of their bands: there their pairs meet first
    once = mixed.where("least != most").groupBy("n", "_x", "_y").agg(F.min(F.struct("band", "key", "chars")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("b.chars") / BLOCK_CHARS)).cast("int")
    rows = placed.drop("band", "chars").join(once.select("b.key", "b.band", blocks.alias("blocks")), "key")
    rows = stage(rows.withColumn("block", F.pmod(mark, F.col("blocks")).cast("int")), "open-buckets")
    if rows.isEmpty():
        return None
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiled = rows.select("key", "band", "node", "part", "block", other.alias("_o"))
    low, high = F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high")
    tiled = tiled.select("key", low, high, "block", "node", "part", "band")
    least = int((similarity - SLACK) * REGISTERS)

    def likely(held: list[tuple]) -> dict:
        _, part = np.unique([r[5] for r in held], return_inverse=True)
        bands, owner = np.array([r[7] for r in held]), np.array([r[8] for r in held])
        some = np.flatnonzero(likely_members(bands, owner, part, _sides(held, 3), held[0][6], least))
        return {c: [held[i][k] for i in some] for k, c in enumerate(("key", "low", "high", "block", "node", "part"))}

    sketched = tiled.join(nodes.select("node", "bands", "registers"), "node")
    sketched = sketched.select(*_TILE, "block", "node", "part", "band", "bands", "registers")
    suspects = stage(_by_tile(sketched, likely, "key long, low int, high int, block int, node binary, part binary"), "suspects")
    if suspects.isEmpty():
        return None
    full = suspects.join(texts.of(suspects.select("node").distinct()), "node").select(*_TILE, "block", "node", "part", "text")

    def links(held: list[tuple]) -> dict:
        _, part = np.unique([r[5] for r in held], return_inverse=True)
        got = tile_links([r[6] for r in held], part, _sides(held, 3), similarity) if part.max() else []
        return {"a": [held[i][4] for i, _ in got], "b": [held[j][4] for _, j in got]}

    return stage(_by_tile(full, links, "a binary, b binary"), "more-links")


def resolve(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, class_id, first_id, chosen) of every text that is not alone.

    ``first_id`` is the least id of the text, ``chosen`` marks the text that stands for its class.
    """
    with arrow_rows(docs.sparkSession, 1000), scratch(docs.sparkSession) as made:
        rows, lookup = _resolve(docs, similarity)
        return made.keep(rows), made.keep(lookup)


def _resolve(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    rows = stage(sketch(docs), "sketches")
    nodes = stage(
        rows.groupBy("node").agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("chars", "bands", "registers")],
        ),
        "nodes",
    )
    least = int((similarity - SLACK) * REGISTERS)
    banded = nodes.select("node", "chars", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(banded.join(buckets, "key"), "members")
    # the hub of a bucket is the text that shares most buckets with most texts: the least edited of a group of copies
    crowd = shared.groupBy("node").agg(F.sum("n").alias("crowd"))
    hubs = shared.select("key", "node").join(crowd, "node").groupBy("key").agg(F.max(F.struct("crowd", "node"))["node"].alias("rep"))
    members = stage(shared.drop("n").join(hubs, "key"), "members")
    texts = _Texts(docs, nodes)

    stars = members.where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    own = nodes.select(F.col("node").alias("a"), F.col("registers").alias("_ra"))
    other = nodes.select(F.col("node").alias("b"), F.col("registers").alias("_rb"))
    likely = stars.join(own, "a").join(other, "b").where(_agreeing(F.col("_ra"), F.col("_rb")) >= least)
    links = texts.verified(stage(likely.select("a", "b"), "stars"), similarity)
    parts = stage(connected_components(links, "a", "b"), "components")

    more = _rest(members, parts, nodes, texts, similarity)
    if more is not None:
        parts = stage(join_components(parts, more, "a", "b"), "components")

    named = nodes.select("node", "first_id", "copies").join(parts, "node", "left")
    several = named.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("first_id").isNull().alias("_none"), "first_id", F.col("node").alias("_chosen"))
    ids = several.groupBy("component").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("n"))
    ids = stage(ids, "class-ids")
    lookup = left_join_unique(several, ids.select("component", "_least"), ["component"], counts=ids.select("component", "n"))
    lookup = lookup.select(
        "node",
        F.col("_least.first_id").alias("class_id"),
        "first_id",
        (F.col("node") == F.col("_least._chosen")).alias("chosen"),
    )
    return rows, stage(lookup, "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row."""
    rows, lookup = resolve(docs, similarity)
    found = left_join_unique(rows.select("doc_id", "node"), lookup.select("node", "class_id"), ["node"])
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one row of each class, that of the least id."""
    rows, lookup = resolve(docs, similarity)
    own = docs.withColumn("_node", _node())
    found = left_join_unique(own, lookup.select(F.col("node").alias("_node"), "first_id", "chosen"), ["_node"])
    stays = F.col("chosen").isNull() | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    kept = found.where(stays).select(*docs.columns, "_node")
    repeated = rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():  # an id and its text given more than once
        kept = kept.dropDuplicates(["doc_id", "_node"])
    return kept.drop("_node")
