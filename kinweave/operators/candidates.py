"""Candidate pairs by equality rules and sorted neighbourhoods, always through equi-joins.

Every rule is its own hash join. A block whose size passes ``tile_rows`` is cut into tiles: its
records fall into pieces, and each pair of pieces is one cell of the join key, so one task never
holds more than two pieces, however large the block is. Nothing is dropped or capped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, stage
from .ordering import add_row_id, dense_positions
from .skew import left_join_unique

TILE_ROWS = 10_000
#: A large block is cut into at most so many pieces: each of its rows is copied so often, whatever the size of the block.
MOST_PIECES = 32
#: About so many ids stand in one bundle.
BUNDLE_IDS = 256
#: The columns of a bundle: its own key, and the ids of its records.
BUNDLE, IDS = "_bundle", "_ids"
#: What names a pair of bundles, up to :func:`unfold`.
BUNDLED = [f"{c}_{s}" for c in (BUNDLE, IDS) for s in ("l", "r")]

Rule = tuple[str, ...]


def same_on(rule: Rule) -> Column:
    """Both sides equal on every column of the rule (null when a side is null)."""
    return reduce(lambda a, b: a & b, [F.col(f"{c}_l") == F.col(f"{c}_r") for c in rule])


def _side(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns})


def low_id_left(pairs: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """Swap the sides of each pair where needed, so that the lower id is on the left."""
    fine = F.col(f"{id_col}_l") < F.col(f"{id_col}_r")
    l = [F.when(fine, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r")).alias(f"{c}_l") for c in cols]
    r = [F.when(fine, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l")).alias(f"{c}_r") for c in cols]
    return pairs.select(*l, *r)


# ---- bundles ------------------------------------------------------------------------------------


def can_bundle(df: DataFrame | None, cols: list[str], id_col: str) -> bool:
    """True if rows can be grouped by ``cols`` without changing them (fractions may: -0.0; term frequencies are above 0)."""
    if df is None:
        return True
    plain = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.DecimalType, T.BinaryType)
    kinds = {f.name: f.dataType for f in df.schema}
    fine = all(c in kinds and (isinstance(kinds[c], plain) or c.startswith("tf_")) for c in cols)
    return fine and id_col not in cols and isinstance(kinds[id_col], plain)


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """True if no id, a missing one included, occurs twice."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def known_ids(df: DataFrame, id_col: str) -> bool:
    """True if no id is missing or occurs twice."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty()


def bundles(df: DataFrame, cols: list[str], id_col: str, nulls: bool = False) -> DataFrame:
    """Records equal in ``cols`` as one row: ``cols``, a key of its own and the ids; as a table.

    What is measured on pairs of bundles holds for all pairs of their records (:func:`unfold`), so copies are measured once. A group
    of very many records becomes several bundles of bounded size. Missing ids are in no pair of one table, so only ``nulls`` keeps them.
    """
    df = df.select(*cols, id_col) if nulls else df.select(*cols, id_col).where(F.col(id_col).isNotNull())
    keyed = df.withColumn("_same", F.xxhash64(*cols))
    cut = _pieces(keyed, ["_same"], BUNDLE_IDS, "_cut", most=None)
    chunk = F.lit(0)
    if cut is not None:
        keyed = left_join_unique(keyed, cut, ["_same"])
        chunk = F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_cut")).cast("int"), F.lit(0))
    ids = F.collect_list(id_col)
    if nulls:
        missing = F.array_repeat(F.lit(None).cast(df.schema[id_col].dataType), F.count_if(F.col(id_col).isNull()).cast("int"))
        ids = F.concat(ids, missing)
    rows = keyed.withColumn("_chunk", chunk).groupBy(*cols, "_chunk").agg(ids.alias(IDS)).drop("_chunk")
    return stage(rows.withColumn(BUNDLE, F.monotonically_increasing_id()), "bundles")


def bundles_apart(df: DataFrame, cols: list[str], id_col: str) -> tuple[DataFrame, bool]:
    """:func:`bundles` in which records of a repeated id have bundles of their own, with keys below 0; and True if there are any.

    So all bundles with other keys have ids that occur once, and pairs of ids among them belong to one pair of bundles only.
    """
    repeated = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stage(repeated, "repeated")
    if repeated.isEmpty():
        return bundles(df, cols, id_col), False
    marked = left_join_unique(df, repeated.select(id_col, F.lit(True).alias("_again")), [id_col], counts=repeated)
    marked = marked.withColumn("_again", F.when(F.col("_again"), F.col(id_col)))
    rows = bundles(marked, [*cols, "_again"], id_col)
    key = F.when(F.col("_again").isNull(), F.col(BUNDLE)).otherwise(-1 - F.col(BUNDLE))
    return rows.withColumn(BUNDLE, key).drop("_again"), True


def by_repeats(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of :func:`bundles_apart` without and with repeated ids."""
    single = (F.col(f"{BUNDLE}_l") >= 0) & (F.col(f"{BUNDLE}_r") >= 0)
    return pairs.where(single), pairs.where(~single)


def unfold(pairs: DataFrame, id_col: str, same: bool = True) -> DataFrame:
    """The pairs of records of pairs of bundles, with all further columns; with ``same`` the lower id is on the left."""
    a, b = f"{id_col}_l", f"{id_col}_r"
    rest = [c for c in pairs.columns if c not in BUNDLED]
    out = pairs.select(*BUNDLED, *rest)
    # a lambda is not compiled into one loop with the second explode, which would hold all rows of two bundles before the first goes on
    out = out.withColumn(a, F.explode(F.transform(f"{IDS}_l", lambda i: i))).withColumn(b, F.explode(f"{IDS}_r"))
    if not same:
        return out.select(a, b, *rest)
    alone = F.col(f"{BUNDLE}_l") == F.col(f"{BUNDLE}_r")
    fine = F.col(a) < F.col(b)
    out = out.where(fine | (~alone & (F.col(a) > F.col(b))))
    sides = {c[:-2] for c in rest if c.endswith("_l")} & {c[:-2] for c in rest if c.endswith("_r")}

    def placed(c: str) -> Column:
        if c[:-2] not in sides or c[-2:] not in ("_l", "_r"):
            return F.col(c)
        turned = c[:-1] + ("r" if c.endswith("l") else "l")
        return F.when(fine, F.col(c)).otherwise(F.col(turned)).alias(c)

    return out.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *[placed(c) for c in rest])


def pair_count() -> Column:
    """How many pairs of records a pair of bundles of one table stands for, if ids are unique or told :func:`bundles_apart`."""
    n, k = F.size(f"{IDS}_l").cast("long"), F.size(f"{IDS}_r")
    a, b = F.col(f"{BUNDLE}_l"), F.col(f"{BUNDLE}_r")
    # records of one id are no pair
    none = (a < 0) & (b < 0) & (F.col(f"{IDS}_l")[0] == F.col(f"{IDS}_r")[0])
    return F.when(none, F.lit(0).cast("long")).when(a == b, F.expr(f"cast(size({IDS}_l) as long) * (size({IDS}_l) - 1) div 2")).otherwise(n * k)


def spread(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs spread by ``keys`` over as many tasks as a shuffle has: few bytes of bundles may unfold to very many pairs."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spanning_links(pairs: DataFrame, id_col: str) -> DataFrame:
    """Links that join the same records as all pairs of the bundles do, with all further columns: as many as there are records and pairs."""
    a, b = f"{id_col}_l", f"{id_col}_r"
    rest = [c for c in pairs.columns if c not in BUNDLED]
    pairs = stage(pairs, "bundle-links")
    heads = pairs.select(F.array_min(f"{IDS}_l").alias(a), F.array_min(f"{IDS}_r").alias(b), *rest)
    ends = reduce(
        DataFrame.unionAll, [pairs.select(F.col(f"{BUNDLE}_{s}").alias("_b"), F.col(f"{IDS}_{s}").alias("_i"), *rest) for s in ("l", "r")]
    )
    # a bundle in any link is tied together once
    tied = ends.groupBy("_b").agg(*[F.first(c).alias(c) for c in ["_i", *rest]])
    stars = tied.select(F.array_min("_i").alias(a), F.explode("_i").alias(b), *rest)
    found = heads.unionAll(stars).where(F.col(a) != F.col(b))
    return found.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *rest)


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def _pieces(df: DataFrame, keys: list[str], tile_rows: int, out: str, most: int | None = MOST_PIECES) -> DataFrame | None:
    """Keys with more than ``tile_rows`` records and the number of pieces each is cut into, at most ``most``."""
    records = F.sum(F.size(IDS)) if IDS in df.columns else F.count(F.lit(1))
    pieces = F.least(F.ceil(F.col("_n") / tile_rows), F.col("_rows"), F.lit(most or (1 << 31) - 1))
    sizes = (
        df.groupBy(*keys)
        .agg(records.alias("_n"), F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_n") > tile_rows)
        .select(*keys, pieces.cast("int").alias(out))
    )
    sizes = stage(sizes, "pieces")
    return None if sizes.isEmpty() else sizes


def large_keys(
    left: DataFrame, right: DataFrame, keys: list[str], same: bool, tile_rows: int
) -> DataFrame | None:
    """Keys with more than ``tile_rows`` rows on a side; None if there are none."""
    a = _pieces(_known(left, keys), keys, tile_rows, "_p")
    b = None if same else _pieces(_known(right, keys), keys, tile_rows, "_p")
    found = [x.select(*keys) for x in (a, b) if x is not None]
    if not found:
        return None
    return found[0] if len(found) == 1 else stage(reduce(DataFrame.unionAll, found).distinct(), "large")


def by_size(rows: DataFrame, large: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of large blocks, and all others; also a list of keys too long to broadcast meets its hot keys evenly."""
    marked = left_join_unique(rows, large.select(*keys, F.lit(True).alias("_large")), keys)
    return marked.where("_large").select(*rows.columns), marked.where("_large is null").select(*rows.columns)


def split_cells(
    left: DataFrame, right: DataFrame, keys: list[str], id_col: str, same: bool, tile_rows: int | None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with known keys, and the columns that bring their rows together.

    Where no key has more than ``tile_rows`` rows these are the keys. Otherwise each row also gets a
    cell (_i, _j): a key's left rows fall into pieces i and its right rows into pieces j, and every
    row is copied to the cells of its piece. With ``same`` only cells with i <= j exist. A
    ``tile_rows`` of None says the caller knows that no key is large.
    """
    a, b = _known(left, keys), _known(right, keys)
    if tile_rows is None:
        return a, b, keys
    cut_a = _pieces(a, keys, tile_rows, "_pa")
    cut_b = cut_a if same else _pieces(b, keys, tile_rows, "_pb")
    if cut_a is None and cut_b is None:
        return a, b, keys
    on = [*keys, "_i", "_j"]
    if same:
        a = left_join_unique(a, cut_a, keys).withColumn("_pa", F.coalesce("_pa", F.lit(1)))
        a = a.withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_pa")).cast("int"))
        own, last = F.col("_own"), F.col("_pa") - 1
        l = a.withColumn("_i", own).withColumn("_j", F.explode(F.sequence(own, last)))
        r = a.withColumn("_j", own).withColumn("_i", F.explode(F.sequence(F.lit(0), own)))
    else:
        none = left.sparkSession.createDataFrame([], a.select(*keys).schema)
        cut_a = cut_a if cut_a is not None else none.withColumn("_pa", F.lit(1))
        cut_b = cut_b if cut_b is not None else none.withColumn("_pb", F.lit(1))

        def spread(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
            df = left_join_unique(left_join_unique(df, cut_a, keys), cut_b, keys)
            df = df.withColumns({p: F.coalesce(p, F.lit(1)) for p in ("_pa", "_pb")})
            return df.withColumn(own, F.pmod(F.xxhash64(id_col), F.col(mine)).cast("int")).withColumn(
                other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
            )

        l, r = spread(a, "_i", "_j", "_pa", "_pb"), spread(b, "_j", "_i", "_pb", "_pa")
    return l.select(*left.columns, "_i", "_j"), r.select(*right.columns, "_i", "_j"), on


def once(df: DataFrame, id_col: str) -> Column:
    """Each unordered pair of one table once; a bundle of several records also meets itself."""
    a, b = F.col(f"{id_col}_l"), F.col(f"{id_col}_r")
    return (a < b) | ((a == b) & (F.size(f"{IDS}_l") > 1)) if id_col == BUNDLE and IDS in df.columns else a < b


def join_block(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    id_col: str,
    same: bool,
    tile_rows: int | None = TILE_ROWS,
) -> DataFrame:
    """Pairs of ``left`` and ``right`` with equal keys, columns suffixed ``_l`` and ``_r``.

    With ``same`` both sides are one table and each unordered pair comes once, lower id left.
    """
    l, r, on = split_cells(left, right, keys, id_col, same, tile_rows)
    met = same_on(tuple(on))
    in_order = once(left, id_col)
    tiled = len(on) > len(keys)
    if same:
        met = met & ((F.col("_i_l") < F.col("_j_l")) | in_order) if tiled else met & in_order
    # a small table may hold very many pairs: they are spread by key and never left to the tasks that read the table
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (_side(t.repartition(n, *on), s) for t, s in ((l, "l"), (r, "r")))
    pairs = l.hint("merge").join(r, met)
    if not tiled:
        return pairs
    pairs = pairs.drop("_i_l", "_j_l", "_i_r", "_j_r")
    return low_id_left(pairs, left.columns, id_col) if same else pairs


def block(
    df: DataFrame,
    on: list[str],
    id_col: str,
    other: DataFrame | None = None,
    tile_rows: int = TILE_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Pairs sharing a block key, within one table or across two. ``keep`` columns travel with both sides. Bundles give pairs of bundles."""
    kept = [c for c in dict.fromkeys(keep or []) if c != id_col]
    used = list(dict.fromkeys([*on, *kept]))
    if id_col != BUNDLE and can_bundle(df, used, id_col) and can_bundle(other, used, id_col):
        left, right = (None if t is None else bundles(t, used, id_col, other is not None) for t in (df, other))
        return unfold(block(left, on, BUNDLE, right, tile_rows, keep), id_col, other is None)
    need = list(dict.fromkeys([id_col, *([IDS] if id_col == BUNDLE else []), *used]))
    left = df.select(*need)
    right = left if other is None else other.select(*need)
    pairs = join_block(left, right, on, id_col, other is None, tile_rows)
    named = BUNDLED if id_col == BUNDLE else [f"{id_col}_l", f"{id_col}_r"]
    return pairs.select(*named, *[f"{c}_{s}" for c in kept for s in ("l", "r")])


def block_rules(
    df: DataFrame,
    rules: list[Rule],
    id_col: str,
    other: DataFrame | None = None,
    keep: list[str] | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Pairs meeting any rule, once each, tagged with the position of the first rule they meet.

    ``keep`` columns travel with both sides, so comparing needs no further join. A pair is left to
    the earliest rule by testing the earlier rules on the joined row; there is no distinct. Bundles give pairs of bundles.
    """
    used = list(dict.fromkeys([*[c for c in keep or [] if c != id_col], *[c for r in rules for c in r]]))
    if id_col == BUNDLE:
        keep = [*(keep or []), IDS]
    elif can_bundle(df, used, id_col) and can_bundle(other, used, id_col):
        left, right = (None if t is None else bundles(t, used, id_col, other is not None) for t in (df, other))
        return unfold(block_rules(left, rules, BUNDLE, right, keep, tile_rows), id_col, other is None)
    columns = list(dict.fromkeys([id_col, *(keep or []), *[c for r in rules for c in r]]))
    left = df.select(*columns)
    right = left if other is None else other.select(*columns)
    out = [f"{id_col}_l", f"{id_col}_r"]
    out += [f"{c}_{s}" for c in (keep or []) if c != id_col for s in ("l", "r")]
    parts = []
    for k, rule in enumerate(rules):
        pairs = join_block(left, right, list(rule), id_col, other is None, tile_rows)
        for earlier in rules[:k]:
            pairs = pairs.where(~F.coalesce(same_on(earlier), F.lit(False)))
        parts.append(pairs.select(*out, F.lit(k).alias("match_key")))
    return reduce(DataFrame.unionAll, parts)


def equal_pairs(df: DataFrame, sets: list[tuple[str, ...]], other: DataFrame | None = None) -> DataFrame:
    """(set, k): how many pairs are equal on all columns of each set, from the sizes of the groups; no pair is formed.

    All sets are counted in one scan, by grouping sets. Sets without pairs have no row.
    """
    columns = sorted({c for s in sets for c in s})
    rows = df.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    if other is not None:
        rows = rows.unionByName(other.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    # the bit of a column is set where it is not part of the group
    number = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): k for k, s in enumerate(sets)}
    sizes = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id(*columns).alias("_id"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")
    )
    outside = [F.col("_id").bitwiseAND(1 << (len(columns) - 1 - i)) != 0 for i in range(len(columns))]
    known = [F.col(c).isNotNull() | out for c, out in zip(columns, outside, strict=True)]
    a, b = F.col("_a"), F.col("_b")
    pairs = F.expr("_a * (_a - 1) div 2") if other is None else a * b
    counted = sizes.where(reduce(lambda x, y: x & y, known)).groupBy("_id").agg(F.sum(pairs).alias("k"))
    named = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    return counted.select(named[F.col("_id").cast("int")].alias("set"), "k")


def new_pairs(df: DataFrame, rules: list[Rule], other: DataFrame | None = None) -> DataFrame:
    """(match_key, new_pairs): pairs each rule adds to the earlier ones, by inclusion and exclusion.

    A set of rules counts, with its sign, for the last of its rules; sets that ask for the same columns are
    counted together, so a group of any size costs one counter, and all sets come from one scan of the table.
    """
    weights: dict[tuple[int, tuple[str, ...]], int] = {}
    for mask in range(1, 1 << len(rules)):
        chosen = [k for k in range(len(rules)) if mask >> k & 1]
        cols = tuple(sorted({c for k in chosen for c in rules[k]}))
        key = (chosen[-1], cols)
        weights[key] = weights.get(key, 0) + (1 if len(chosen) % 2 else -1)
    used = sorted({cols for (_, cols), w in weights.items() if w})
    signs = df.sparkSession.createDataFrame(
        [(k, used.index(cols), w) for (k, cols), w in weights.items() if w], "match_key int, set int, sign int"
    )
    # one row for each set of columns
    found = signs.join(F.broadcast(equal_pairs(df, used, other)), "set")
    return found.groupBy("match_key").agg(F.sum(F.col("k") * F.col("sign")).alias("new_pairs"))


def cumulative_comparisons(
    df: DataFrame, rules: list[Rule], id_col: str, other: DataFrame | None = None
) -> DataFrame:
    """New pairs each rule adds and the running total. Rules without new pairs show 0."""
    names = df.sparkSession.createDataFrame(
        [(k, " and ".join(r)) for k, r in enumerate(rules)], "match_key int, rule string"
    )
    # one row per rule
    w = Window.orderBy("match_key")
    counted = names.join(F.broadcast(new_pairs(df, rules, other)), "match_key", "left").withColumn(
        "new_pairs", F.coalesce("new_pairs", F.lit(0).cast("long"))
    )
    return counted.withColumn("cumulative_pairs", F.sum("new_pairs").over(w))


def deterministic_link(
    df: DataFrame, rules: list[Rule], id_col: str, other: DataFrame | None = None
) -> DataFrame:
    """Pairs meeting one of the exact rules."""
    return block_rules(df, rules, id_col, other)


def sorted_neighbourhood(
    df: DataFrame,
    on: str,
    id_col: str,
    window: int = 5,
    keep: list[str] | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Pairs whose values of ``on`` lie at most (window-1)/2 places apart among the sorted distinct values.

    ``keep`` columns travel with both sides. Bundles give pairs of bundles.
    """
    if window % 2 == 0 or window < 1:
        raise ValueError("window must be odd")
    used = list(dict.fromkeys([on, *[c for c in keep or [] if c != id_col]]))
    if id_col != BUNDLE and can_bundle(df, used, id_col) and known_ids(df, id_col):
        found = sorted_neighbourhood(bundles(df, used, id_col), on, BUNDLE, window, keep, tile_rows)
        return unfold(found, id_col)
    reach = (window - 1) // 2
    cols = list(dict.fromkeys([id_col, *(keep or []), *([IDS] if id_col == BUNDLE else [])]))
    ranks = dense_positions(df, on, out="_rank")
    known = df.where(F.col(on).isNotNull()).select(*dict.fromkeys([*cols, on]))
    rows = left_join_unique(known, ranks, [on]).select(*cols, "_rank")
    ahead = rows.withColumn("_meet", F.explode(F.sequence(F.col("_rank"), F.col("_rank") + reach)))
    here = rows.withColumn("_meet", F.col("_rank"))
    pairs = join_block(ahead, here, ["_meet"], id_col, False, tile_rows)
    return low_id_left(pairs.where((F.col("_rank_l") < F.col("_rank_r")) | once(df, id_col)), cols, id_col)


def canonical_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pair key with the lower id left; rows pairing a record with itself go."""
    a, b = F.col(left), F.col(right)
    return pairs.where(a != b).select(F.least(a, b).alias(left), F.greatest(a, b).alias(right))


def union_candidates(a: DataFrame, b: DataFrame, told: list[str] | None = None) -> DataFrame:
    """Both candidate lists, each pair once; pairs of bundles are told apart by their keys.

    With ``told`` each list holds a pair once, and ``a`` has all pairs that are equal on these columns, which the pairs carry: what
    both lists hold is told on the row, and no pair is shuffled.
    """
    if told:
        return a.unionByName(b.where(~F.coalesce(same_on(tuple(told)), F.lit(False))))
    both = a.unionByName(b)
    return spread(both, BUNDLED[:2]).dropDuplicates(BUNDLED[:2]) if set(BUNDLED) <= set(both.columns) else both.dropDuplicates()


def rows_for_pairs(max_pairs: int) -> int:
    """Most rows whose pairs stay within ``max_pairs``."""
    n = int((1 + (1 + 8 * max_pairs) ** 0.5) / 2)
    while n * (n - 1) // 2 > max_pairs:
        n -= 1
    return n


def _sample_rows(df: DataFrame, id_col: str, n: int, total: int, seed: int) -> DataFrame:
    """The ``n`` of ``total`` rows whose keyed digest is smallest, numbered from 0 without a sort in one task.

    Digests are even, so a cut leaves little more than ``n`` rows, which alone are sorted, by ranges.
    """
    digest = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    keyed = df.withColumn("_digest", digest)
    share = (n + 6 * math.sqrt(n) + 6) / max(total, 1)
    while share < 1:
        cut = f"{int(share * (1 << 60)):015x}"
        few = stage(keyed.where(F.col("_digest") < cut), "sampled")
        if few.count() >= n:
            keyed = few
            break
        share *= 2
    return add_row_id(keyed, ["_digest", id_col], 0, "_pos").where(F.col("_pos") < n).drop("_digest")


def sample_rows(
    df: DataFrame, id_col: str, max_pairs: int, seed: int, other: DataFrame | None, keep: list[str]
) -> tuple[DataFrame, DataFrame, int]:
    """The rows whose pairs make a sample, of one table (twice) or of two, with ``_pos`` from 0; and those of the larger side."""
    cols = list(dict.fromkeys([id_col, *keep]))
    if other is None:
        total = df.count()
        n = min(rows_for_pairs(max_pairs), total)
        rows = stage(_sample_rows(df.select(*cols), id_col, n, total, seed), "sample")
        return rows, rows, n
    na, nb = df.count(), other.count()
    # the smaller side keeps up to the square root of the bound, the other fills what is left
    small = min(na, nb, math.isqrt(max_pairs))
    large = min(max(na, nb), max_pairs // max(small, 1))
    m, n = (small, large) if na <= nb else (large, small)
    left = stage(_sample_rows(df.select(*cols), id_col, m, na, seed), "sample")
    return left, stage(_sample_rows(other.select(*cols), id_col, n, nb, seed), "sample"), large


def sample_pairs(
    df: DataFrame,
    id_col: str,
    max_pairs: int = 1_000_000,
    seed: int = 1,
    other: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every pair of a random row sample sized so that the pairs stay within ``max_pairs``.

    Pair numbers are generated in parallel and turned into two row positions, so the pairs come from
    two lookups in a sample of about sqrt(2·max_pairs) rows and never from a cross join.
    """
    spark = df.sparkSession
    cols = list(dict.fromkeys([id_col, *(keep or [])]))
    p = F.col("id")
    left, right, _ = sample_rows(df, id_col, max_pairs, seed, other, cols)
    n = right.count()
    if other is None:
        numbers = spark.range(n * (n - 1) // 2)
        j = F.floor((1 + F.sqrt(1 + 8 * p)) / 2).cast("long")
        j = F.when(j * (j - 1) / 2 > p, j - 1).when((j + 1) * j / 2 <= p, j + 1).otherwise(j)
        numbers = numbers.select(p, j.alias("_j")).select(
            (p - (F.col("_j") * (F.col("_j") - 1) / 2).cast("long")).alias("_pos_l"),
            F.col("_j").alias("_pos_r"),
        )
    else:
        numbers = spark.range(left.count() * n).select(
            F.floor(p / n).cast("long").alias("_pos_l"), (p % n).alias("_pos_r")
        )
    # a lopsided link sample may keep many rows of the larger side, so its broadcast is checked
    left, right = _side(left, "l"), _side(right, "r")
    left, right = broadcast_if_small(left), broadcast_if_small(right)
    pairs = numbers.join(left, "_pos_l").join(right, "_pos_r").drop("_pos_l", "_pos_r")
    return low_id_left(pairs, cols, id_col) if other is None else pairs


def all_pairs(df: DataFrame, id_col: str, keep: list[str] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every pair of a table, lower id left: one block of all rows, cut into tiles.

    Its size is the square of the table's by definition; jobs use exact joins or blocking rules instead.
    """
    cols = list(dict.fromkeys([id_col, *(keep or [])]))
    rows = df.select(*cols).withColumn("_all", F.lit(1))
    return join_block(rows, rows, ["_all"], id_col, True, tile_rows).drop("_all_l", "_all_r")


def attach_records(
    pairs: DataFrame, df: DataFrame, id_col: str, other: DataFrame | None = None
) -> DataFrame:
    """Fetch both sides' fields for a pair list keyed by ``<id>_l`` and ``<id>_r``; pairs that carry all of them stay as they are."""
    right = df if other is None else other
    named = {f"{c}_l" for c in df.columns} | {f"{c}_r" for c in right.columns}
    if len(named) > 2 and named <= set(pairs.columns):
        return pairs
    out = left_join_unique(pairs, _side(df, "l"), [f"{id_col}_l"])
    return left_join_unique(out, _side(right, "r"), [f"{id_col}_r"])


def attach_predictions(features: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Features with their prediction, joined on the pair key rather than on row position."""
    if set(BUNDLED) <= set(features.columns):
        features, predictions = spread(features, keys), spread(predictions, keys)
    return features.join(predictions, keys, "left")


def map_labels(
    true_links: DataFrame, df: DataFrame, id_col: str, source_col: str, other: DataFrame | None = None
) -> DataFrame:
    """Pairs of natural keys to pairs of ids and source names; pairs with an unknown side go.

    ``true_links`` has columns ``key_l`` and ``key_r``; ``df`` has ``key``, the id and the source.
    """
    right = df if other is None else other
    l = df.select(F.col("key").alias("key_l"), F.col(id_col).alias("unique_id_l"), F.col(source_col).alias("source_dataset_l"))
    r = right.select(F.col("key").alias("key_r"), F.col(id_col).alias("unique_id_r"), F.col(source_col).alias("source_dataset_r"))
    return (
        true_links.join(l, "key_l")
        .join(r, "key_r")
        .select("unique_id_l", "source_dataset_l", "unique_id_r", "source_dataset_r")
    )
