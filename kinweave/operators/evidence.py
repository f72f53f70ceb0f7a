"""Thresholded scoring of very large blocks without forming all their pairs.

A pair that agrees on a blocking rule only is worth a known weight. If that is below what the
threshold asks for, the pair must also agree, exactly or closely, on at least one of a few further
fields. So a large block is joined once per such field on (block key, field value), where a record is
copied to the values close to its own. Close values are sought among the distinct values of one
block through an index of segments or letters, so only few of their pairs are measured. No pair that reaches
the threshold is lost, and nothing is capped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import length_allows
from ..session import stage
from .candidates import TILE_ROWS, Rule, attach_records, by_size, join_block, large_keys, once, same_on
from .compare import Comparison, add_gammas
from .patterns import block_reaching, can_tabulate, rare_exact
from .valueindex import can_index, candidate_pairs


@dataclass(frozen=True)
class Evidence:
    """A field, and the levels of it that speak for a match."""

    comparison: Comparison
    gammas: frozenset[int]

    @property
    def exact(self) -> bool:
        return len(self.comparison.scored) - 1 in self.gammas

    def loosest(self):
        """The loosest level in use that is not plain equality, or None."""
        n = len(self.comparison.scored)
        used = [l for i, l in enumerate(self.comparison.scored) if n - 1 - i in self.gammas and i > 0]
        return used[-1] if used else None


def plan_evidence(
    comparisons: list[Comparison], rule: Rule, needed: float, extra: dict[str, list[float]]
) -> list[Evidence] | None:
    """Fields of which at least one must speak for a match, for a pair of this block to gain ``needed``.

    ``extra`` bounds the term-frequency weight of each level of a field. Fields are left out, the least telling first,
    as long as all the left-out ones together cannot make up ``needed``. None if the block key alone
    suffices, or if a field that cannot be joined on would have to be used.
    """
    sure = 0.0
    choices = []
    for c in comparisons:
        more = extra.get(c.name) or [0.0] * len(c.scored)
        w = [math.log2(l.m / l.u) + x for l, x in zip(c.scored, more, strict=True)]
        if c.column in rule:
            sure += w[0]
            continue
        n = len(w)
        levels = {n - 1 - i: v for i, v in enumerate(w)}
        good = frozenset(g for g, v in levels.items() if v > 0)
        if not good:
            continue
        known = all(l.metric in ("null", "exact", "levenshtein", "jaro_winkler", "else") for l in c.levels)
        joinable = known and 0 not in good
        chance = sum(l.u for i, l in enumerate(c.scored) if n - 1 - i in good)
        choices.append((joinable, -chance, max(levels.values()), Evidence(c, good)))
    room = needed - sure - 1e-6
    if room <= 0:
        return None
    kept = []
    # fields that cannot be joined on come first, then those most often alike by chance
    for joinable, _, best, e in sorted(choices, key=lambda t: (t[0], t[1])):
        if best < room:
            room -= best
        elif joinable:
            kept.append(e)
        else:
            return None
    return kept


def close_values(values: DataFrame, keys: list[str], e: Evidence, tile_rows: int = TILE_ROWS) -> DataFrame | None:
    """(keys, v_l, v_r): pairs of different values of one block at one of the evidence levels, both ways.

    ``values`` holds the distinct (keys, v). Each unordered pair that the index leaves is measured once.
    """
    level = e.loosest()
    if level is None:
        return None
    pairs = value_pairs(values, keys, level, tile_rows)
    c = e.comparison
    on = [f"{k}_l" for k in keys]
    named = pairs.select(*on, F.col("v_l").alias(f"{c.column}_l"), F.col("v_r").alias(f"{c.column}_r"))
    judged = add_gammas(named.withColumnsRenamed({k: f"_key_{k}" for k in on}), [c])
    judged = judged.where(F.col(f"gamma_{c.name}").isin(*e.gammas))
    back = [F.col(f"_key_{k}_l").alias(k) for k in keys]
    one = judged.select(*back, F.col(f"{c.column}_l").alias("v_l"), F.col(f"{c.column}_r").alias("v_r"))
    return stage(one.unionAll(one.select(*keys, F.col("v_r"), F.col("v_l"))), "close")


def value_pairs(values: DataFrame, keys: list[str], level, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Unordered pairs of different values of a block that may be at the level, each once.

    They come from the index; where the level is too loose for it, from tiles, as far as lengths allow.
    """
    if can_index(level):
        return candidate_pairs(values, keys, level, tile_rows)
    pairs = join_block(values, values, keys, "v", True, tile_rows)
    return pairs.where(length_allows(F.col("v_l"), F.col("v_r"), level.cut))


def _by_evidence(
    l: DataFrame, r: DataFrame, keys: list[str], id_col: str, same: bool, e: Evidence, tile_rows: int
) -> DataFrame:
    """Pairs of a large block that agree on one field at an evidence level."""
    col = e.comparison.column
    values = l.select(*keys, F.col(col).alias("v"))
    if not same:
        values = values.unionAll(r.select(*keys, F.col(col).alias("v")))
    values = stage(values.where(F.col("v").isNotNull()).distinct(), "values")
    near = close_values(values, keys, e, tile_rows)
    left = l.where(F.col(col).isNotNull())
    ways = [left.withColumn("_value", F.col(col))] if e.exact else []
    if near is not None:
        lookup = near.withColumnsRenamed({"v_l": col, "v_r": "_value"})
        ways.append(left.join(lookup, [*keys, col]).select(*left.columns, "_value"))
    left = reduce(DataFrame.unionAll, ways)
    right = r.withColumn("_value", F.col(col))
    pairs = join_block(left, right, [*keys, "_value"], id_col, False, tile_rows).drop("_value_l", "_value_r")
    return pairs.where(once(l, id_col)) if same else pairs


def reaching_pairs(
    left: DataFrame,
    right: DataFrame,
    rules: list[Rule],
    comparisons: list[Comparison],
    needed: float,
    id_col: str,
    same: bool,
    keep: list[str],
    tile_rows: int,
    told: bool = False,
) -> tuple[DataFrame, bool]:
    """Every pair of the rules that can gain ``needed`` (and others); True if pairs may come twice.

    Blocks of ordinary size are joined as they are, larger ones by evidence, and those that no
    evidence can narrow are tiled. Where ``told`` says that no id is missing or occurs twice in a table, ordinary blocks, and those that
    would be tiled, are looked through as arrays, and only the pairs that gain ``needed`` become rows.
    """
    told = told and rare_exact(comparisons) is not None and all(can_tabulate(t, comparisons) for t in (left, right))

    def joined(l: DataFrame, r: DataFrame, keys: list[str], tiles: int | None) -> DataFrame:
        if not told:
            return join_block(l, r, keys, id_col, same, tiles)
        ids = stage(block_reaching(l, r, keys, comparisons, needed, id_col, same, tiles), "reaching")
        return attach_records(ids, l, id_col, None if same else r)

    out = [f"{id_col}_l", f"{id_col}_r"]
    out += [f"{c}_{s}" for c in keep if c != id_col for s in ("l", "r")]
    parts, repeated = [], False
    for k, rule in enumerate(rules):
        keys = list(rule)
        large = large_keys(left, right, keys, same, tile_rows)
        plan = None
        if large is not None:
            in_large, rest_l = by_size(left, large, keys)
            plan = plan_evidence(comparisons, rule, needed, _extra_weights(in_large, comparisons))
        if plan is None:
            found = [joined(left, right, keys, tile_rows if large is not None else None)]
        else:
            repeated = repeated or len(plan) > 1
            l = in_large
            r, rest_r = (in_large, rest_l) if same else by_size(right, large, keys)
            found = [joined(rest_l, rest_r, keys, None)]
            found += [_by_evidence(l, r, keys, id_col, same, e, tile_rows) for e in plan]
        for pairs in found:
            for earlier in rules[:k]:
                pairs = pairs.where(~F.coalesce(same_on(earlier), F.lit(False)))
            parts.append(pairs.select(*out, F.lit(k).alias("match_key")))
    return reduce(DataFrame.unionAll, parts), repeated


def _extra_weights(rows: DataFrame, comparisons: list[Comparison]) -> dict[str, list[float]]:
    """Largest term-frequency weight of each level of each field: that of the rarest value in these blocks."""
    cols = list(dict.fromkeys(t for c in comparisons for t in c.tf_columns))
    if not cols:
        return {}
    seen = rows.agg(*[f(f"tf_{t}").alias(f"{n}_{t}") for t in cols for n, f in (("min", F.min), ("max", F.max))]).first()

    def bound(level) -> float:
        least, most = (seen[f"{n}_{level.tf_column}"] if level.tf_column else None for n in ("min", "max"))
        if not least:
            return 0.0
        # a missing frequency adds nothing, so 0 is always in reach; a negative weight gains by frequent values
        rarest = least if level.tf_weight >= 0 else most
        return max(0.0, level.tf_weight * math.log2(level.u / rarest))

    return {c.name: [bound(level) for level in c.scored] for c in comparisons}
