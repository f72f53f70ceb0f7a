"""The match model: u from sampled pairs, m by expectation-maximisation, scoring, storage.

Probabilities live in :class:`Model`, a handful of numbers. Everything that grows with the data —
pairs, levels, pattern counts — stays in DataFrames.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, replace
from functools import reduce
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import length_allows, register
from ..session import stage
from .candidates import BUNDLE, IDS, TILE_ROWS, Rule, block_rules, bundles, can_bundle, join_block, new_pairs, sample_pairs, sample_rows, unfold, unique_ids
from .compare import Comparison, Level, add_gammas, exact_match, with_term_frequencies
from .evidence import reaching_pairs
from .patterns import block_patterns, can_tabulate, rare_exact

# fixed values: prior of a fresh model, share of m on the exact level before training, EM stopping
DEFAULT_PRIOR = 0.0001
DEFAULT_EXACT_M = 0.95
EM_ROUNDS = 25
EM_CONVERGED = 1e-4


@dataclass(frozen=True)
class Model:
    comparisons: tuple[Comparison, ...]
    rules: tuple[Rule, ...]
    prior: float = DEFAULT_PRIOR
    link_type: str = "dedupe_only"

    def comparison(self, name: str) -> Comparison:
        return next(c for c in self.comparisons if c.name == name)

    @property
    def columns(self) -> list[str]:
        """Every record column the model reads."""
        names = [c.column for c in self.comparisons] + [c for r in self.rules for c in r]
        return list(dict.fromkeys(names))

    @property
    def tf_columns(self) -> list[str]:
        return list(dict.fromkeys(t for c in self.comparisons for t in c.tf_columns))


def default_m(levels: int) -> list[float]:
    """m before training, strictest level first: most on the exact level, the rest even."""
    if levels == 1:
        return [1.0]
    return [DEFAULT_EXACT_M] + [(1 - DEFAULT_EXACT_M) / (levels - 1)] * (levels - 1)


def default_u(levels: int) -> list[float]:
    """u before training: the mirror image of the default m."""
    return list(reversed(default_m(levels)))


def filled(c: Comparison) -> Comparison:
    """Defaults wherever a level has no learnt m or u."""
    n = len(c.scored)
    m, u = default_m(n), default_u(n)
    return c.with_probabilities(
        {c.gamma_of(i): (l.m if l.m else m[i]) for i, l in enumerate(c.scored)},
        {c.gamma_of(i): (l.u if l.u else u[i]) for i, l in enumerate(c.scored)},
    )


def log_odds(p: float) -> float:
    return math.log2(p / (1 - p))


# ---- u ------------------------------------------------------------------------------------------


#: Pieces of the larger side of a sample whose pairs are counted.
U_PIECES = 8


def level_counts(patterns: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Pairs per (comparison, gamma) from the pairs ``n`` of each pattern, missing sides left out."""
    names = [f"gamma_{c.name}" for c in comparisons]
    return (
        patterns.unpivot(["n"], names, "name", "gamma")
        .where(F.col("gamma") >= 0)
        .groupBy(F.expr("substr(name, 7)").alias("comparison"), "gamma")
        .agg(F.sum("n").alias("n"))
    )


def u_table(
    df: DataFrame,
    comparisons: list[Comparison],
    id_col: str,
    max_pairs: int = 1_000_000,
    seed: int = 1,
    other: DataFrame | None = None,
) -> DataFrame:
    """(comparison, gamma, n, u): level shares among randomly sampled pairs."""
    keep = list(dict.fromkeys(c.column for c in comparisons))
    if can_tabulate(df, comparisons) and (other is None or can_tabulate(other, comparisons)):
        left, right, rows = sample_rows(df, id_col, max_pairs, seed, other, keep)
        left, right = (t.withColumns({"_all": F.lit(1), "copies": F.lit(1).cast("long")}) for t in (left, right))
        # one block of all sampled rows, in as many cells as keep the tasks busy
        patterns = block_patterns(left, right, ["_all"], comparisons, id_col, other is None, max(rows // U_PIECES, 1))
    else:
        pairs = add_gammas(sample_pairs(df, id_col, max_pairs, seed, other, keep), comparisons)
        patterns = pairs.groupBy(*[f"gamma_{c.name}" for c in comparisons]).agg(F.count(F.lit(1)).alias("n"))
    counts = stage(level_counts(patterns, comparisons), "levels")
    totals = counts.groupBy("comparison").agg(F.sum("n").alias("_all"))
    # a handful of rows per comparison
    return counts.join(F.broadcast(totals), "comparison").select(
        "comparison", "gamma", "n", (F.col("n") / F.col("_all")).alias("u")
    )


def estimate_u(
    model: Model,
    df: DataFrame,
    id_col: str,
    max_pairs: int = 1_000_000,
    seed: int = 1,
    other: DataFrame | None = None,
) -> Model:
    """u of every level; a level no sampled pair reached keeps its default."""
    found: dict[str, dict[int, float]] = {}
    for r in u_table(df, list(model.comparisons), id_col, max_pairs, seed, other).collect():
        found.setdefault(r["comparison"], {})[r["gamma"]] = r["u"]
    return replace(
        model,
        comparisons=tuple(c.with_probabilities(u=found.get(c.name, {})) for c in model.comparisons),
    )


# ---- copies -------------------------------------------------------------------------------------


def collapse_copies(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """One row per distinct combination of ``cols`` with its lowest id and its number of copies.

    The aggregation is partial on the map side, so a group of copies of any size is one row per task
    before the shuffle; pairs are then formed between distinct records only.
    """
    return df.groupBy(*cols).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


# ---- m by expectation-maximisation --------------------------------------------------------------


def pattern_counts(
    df: DataFrame,
    rule: Rule,
    comparisons: list[Comparison],
    id_col: str,
    other: DataFrame | None = None,
    tile_rows: int = TILE_ROWS,
    collapsed: bool = False,
) -> DataFrame:
    """Pairs per gamma pattern among the pairs meeting ``rule``. ``collapsed`` tables hold distinct records with ``copies``.

    Copies are collapsed first: two distinct records stand for copies·copies pairs, and a record with
    k copies for k(k-1)/2 pairs of equal records. Records are dealt out by block and a task counts the patterns
    of its pairs without making rows of them; only levels of other kinds, or fields of other types, are judged on pair rows.
    """
    cols = list(dict.fromkeys([*rule, *[c.column for c in comparisons]]))
    names = [f"gamma_{c.name}" for c in comparisons]
    if collapsed:
        left, right = (None if t is None else t.select(id_col, *cols, "copies") for t in (df, other))
        right = left if right is None else right
    elif other is None:
        left = right = stage(collapse_copies(df, cols, id_col), "profiles")
    else:
        left, right = collapse_copies(df, cols, id_col), collapse_copies(other, cols, id_col)
    if can_tabulate(left, comparisons) and can_tabulate(right, comparisons):
        weighted = block_patterns(left, right, list(rule), comparisons, id_col, other is None, tile_rows)
        weighted = weighted.withColumnRenamed("n", "w")
    else:
        pairs = join_block(left, right, list(rule), id_col, other is None, tile_rows)
        weighted = add_gammas(pairs, comparisons).select(
            *names, (F.col("copies_l") * F.col("copies_r")).alias("w")
        )
    if other is None:
        alike = left.where(
            (F.col("copies") > 1) & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule])
        )
        alike = alike.select(
            *[F.col(c).alias(f"{c}_{s}") for c in cols for s in ("l", "r")],
            (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("w"),
        )
        weighted = weighted.unionByName(add_gammas(alike, comparisons).select(*names, "w"))
    return weighted.groupBy(*names).agg(F.sum("w").alias("n"))


def _weight(c: Comparison) -> Column:
    """log2(m/u) of the pattern's level; nothing for a missing side."""
    out = F.when(F.col(f"gamma_{c.name}") == -1, F.lit(0.0))
    for i, l in enumerate(c.scored):
        out = out.when(F.col(f"gamma_{c.name}") == c.gamma_of(i), F.lit(math.log2(l.m / l.u)))
    return out


def _probability(weight: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(2.0), -weight))


@dataclass(frozen=True)
class Session:
    """One EM run: learnt m per comparison and gamma, the share of matches, and its course."""

    rule: Rule
    m: dict[str, dict[int, float]]
    prior: float
    rounds: int
    log_likelihood: tuple[float, ...]


#: So many patterns are held on the driver for the rounds of EM; there are at most the product of the level counts.
LOCAL_PATTERNS = 1 << 20


def _spark_sums(patterns: DataFrame):
    """Sums of a round as one aggregation to a single row."""

    def sums(current: list[Comparison], prior: float) -> dict:
        weight = reduce(lambda a, b: a + b, [_weight(c) for c in current], F.lit(log_odds(prior)))
        scored = patterns.withColumn("_w", weight).withColumn("_pn", _probability(F.col("_w")) * F.col("n"))
        out = [F.sum("_pn").alias("p"), F.sum("n").alias("n")]
        out.append(F.sum(F.col("n") * F.log1p(F.pow(F.lit(2.0), F.col("_w")))).alias("gain"))
        for c in current:
            for g in range(len(c.scored)):
                hit = F.col(f"gamma_{c.name}") == g
                out.append(F.sum(F.when(hit, F.col("_pn"))).alias(f"{c.name}|{g}"))
        return scored.agg(*out).first().asDict()

    return sums


def _local_sums(patterns: DataFrame, comparisons: list[Comparison]):
    """Sums of a round over a bounded table of patterns on the driver; no Spark job a round."""
    held = patterns.toArrow()
    n = np.asarray(held.column("n"), dtype=np.float64)
    gammas = [np.asarray(held.column(f"gamma_{c.name}"), dtype=np.int64) for c in comparisons]

    def sums(current: list[Comparison], prior: float) -> dict:
        w = np.full(len(n), log_odds(prior))
        for c, g in zip(current, gammas, strict=True):
            # index -1, a missing side, is the last entry and adds nothing
            w += np.array([*(math.log2(l.m / l.u) for l in reversed(c.scored)), 0.0])[g]
        pn = n / (1.0 + np.exp2(-w))
        out = {"p": pn.sum(), "n": n.sum(), "gain": (n * np.logaddexp(0.0, w * math.log(2))).sum()}
        for c, g in zip(current, gammas, strict=True):
            by = np.bincount(g + 1, weights=pn, minlength=len(c.scored) + 1)
            out |= {f"{c.name}|{k}": v for k, v in enumerate(by[1:].tolist())}
        return out

    return sums


def run_em(
    patterns: DataFrame,
    comparisons: list[Comparison],
    prior: float,
    rule: Rule = (),
    rounds: int = EM_ROUNDS,
    tolerance: float = EM_CONVERGED,
    local_patterns: int = LOCAL_PATTERNS,
) -> Session:
    """EM over the pattern counts with u fixed; rounds run on the driver while the patterns are few enough, counted first."""
    current = [filled(c) for c in comparisons]
    likelihood = []
    done = 0
    few = patterns.limit(local_patterns + 1).count() <= local_patterns
    sums = _local_sums(patterns, comparisons) if few else _spark_sums(patterns)
    for done in range(1, rounds + 1):
        row = sums(current, prior)
        if not row["n"]:
            break
        # log P(pattern | no match) is constant over rounds, so it is left out of the likelihood
        likelihood.append(row["gain"] + row["n"] * math.log(1 - prior))
        new_prior = min(max(row["p"] / row["n"], 1e-12), 1 - 1e-12)
        change = abs(new_prior - prior)
        updated = []
        for c in current:
            got = {g: row[f"{c.name}|{g}"] or 0.0 for g in range(len(c.scored))}
            total = sum(got.values())
            m = {g: v / total for g, v in got.items() if v > 0} if total else {}
            old = {c.gamma_of(i): l.m for i, l in enumerate(c.scored)}
            change = max([change] + [abs(v - old[g]) for g, v in m.items()])
            updated.append(c.with_probabilities(m=m))
        current, prior = updated, new_prior
        if change < tolerance:
            break
    seen = _observed(patterns, comparisons)
    return Session(
        rule,
        {
            c.name: {
                c.gamma_of(i): l.m
                for i, l in enumerate(c.scored)
                if (c.name, c.gamma_of(i)) in seen
            }
            for c in current
        },
        prior,
        done,
        tuple(likelihood),
    )


def _observed(patterns: DataFrame, comparisons: list[Comparison]) -> set[tuple[str, int]]:
    """Levels that occur among the patterns: only these are learnt, others keep their default."""
    row = patterns.agg(
        *[
            F.max((F.col(f"gamma_{c.name}") == g).cast("int")).alias(f"{c.name}|{g}")
            for c in comparisons
            for g in range(len(c.scored))
        ]
    ).first()
    return {(c.name, g) for c in comparisons for g in range(len(c.scored)) if row[f"{c.name}|{g}"] == 1}


def trainable(model: Model, rule: Rule) -> list[Comparison]:
    """Comparisons a training rule leaves free: those on its own columns are always equal."""
    return [c for c in model.comparisons if c.column not in rule]


def start_prior(model: Model, rule: Rule) -> float:
    """Prior among pairs meeting the rule: the model's odds times the exact levels the rule implies."""
    weight = log_odds(model.prior)
    for c in model.comparisons:
        if c.column in rule:
            top = filled(c).scored[0]
            weight += math.log2(top.m / top.u)
    weight = min(max(weight, -60.0), 60.0)
    return 1 / (1 + 2**-weight)


def estimate_m_em(
    model: Model,
    df: DataFrame,
    rule: Rule,
    id_col: str,
    other: DataFrame | None = None,
    rounds: int = EM_ROUNDS,
    tolerance: float = EM_CONVERGED,
    collapsed: bool = False,
) -> Session:
    """One EM session on the pairs meeting ``rule``."""
    free = trainable(model, rule)
    patterns = stage(pattern_counts(df, rule, free, id_col, other, collapsed=collapsed), "patterns")
    return run_em(patterns, free, start_prior(model, rule), rule, rounds, tolerance)


def combine_sessions(model: Model, sessions: list[Session]) -> Model:
    """Median of the learnt m over the sessions; levels no session learnt keep their default."""
    out = []
    for c in model.comparisons:
        values: dict[int, list[float]] = {}
        for s in sessions:
            for g, v in s.m.get(c.name, {}).items():
                values.setdefault(g, []).append(v)
        out.append(c.with_probabilities(m={g: median(v) for g, v in values.items()}))
    return replace(model, comparisons=tuple(filled(c) for c in out))


def estimate_prior(
    df: DataFrame, rules: list[Rule], id_col: str, recall: float = 0.8, other: DataFrame | None = None
) -> DataFrame:
    """One row: pairs meeting the exact rules, all pairs, and the prior they imply.

    Rule pairs are counted by inclusion and exclusion over equality groups, so a group of any size
    costs one counter and no pair is formed.
    """
    matched = new_pairs(df, rules, other).agg(F.sum("new_pairs").alias("rule_pairs"))
    if other is None:
        n = F.col("n")
        total = df.agg(F.count(F.lit(1)).alias("n")).select((n * (n - 1) / 2).cast("long").alias("all_pairs"))
    else:
        rows = other.agg(F.count(F.lit(1))).scalar()
        total = df.agg((F.count(F.lit(1)) * rows).alias("all_pairs"))
    return total.withColumn("rule_pairs", matched.scalar()).select(
        "rule_pairs", "all_pairs", (F.col("rule_pairs") / recall / F.col("all_pairs")).alias("prior")
    )


def with_estimated_prior(
    model: Model, df: DataFrame, rules: list[Rule], id_col: str, recall: float = 0.8, other: DataFrame | None = None
) -> Model:
    value = estimate_prior(df, rules, id_col, recall, other).first()["prior"]
    return replace(model, prior=min(max(value, 1e-12), 1 - 1e-12))


# ---- scoring ------------------------------------------------------------------------------------


def _tf_weight(c: Comparison) -> Column | None:
    """Extra weight of agreeing on a rare value, on the level that carries the adjustment only."""
    out = None
    for i, l in enumerate(c.scored):
        if not l.tf_column:
            continue
        tf = F.greatest(F.col(f"tf_{l.tf_column}_l"), F.col(f"tf_{l.tf_column}_r"))
        extra = F.coalesce(F.lit(l.tf_weight) * F.log2(F.lit(l.u) / tf), F.lit(0.0))
        test = F.col(f"gamma_{c.name}") == c.gamma_of(i)
        out = F.when(test, extra) if out is None else out.when(test, extra)
    return None if out is None else out.otherwise(F.lit(0.0))


def _level_extra(level) -> Column:
    """Term-frequency weight of a level, from the records alone."""
    if not level.tf_column:
        return F.lit(0.0)
    tf = F.greatest(F.col(f"tf_{level.tf_column}_l"), F.col(f"tf_{level.tf_column}_r"))
    return F.coalesce(F.lit(level.tf_weight) * F.log2(F.lit(level.u) / tf), F.lit(0.0))


def _best_weight(c: Comparison) -> Column:
    """Most weight the pair can get from a similarity comparison, without measuring the similarity."""
    a, b = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
    w = [F.lit(math.log2(l.m / l.u)) + _level_extra(l) for l in c.scored]
    cuts = [l.cut for l in c.scored if l.metric == "jaro_winkler"]
    return (
        F.when(a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, w[0])
        .when(length_allows(a, b, min(cuts)), F.greatest(*w[1:]))
        .otherwise(w[-1])
    )


def _measured(c: Comparison) -> bool:
    kinds = [l.metric for l in c.levels]
    plain = kinds[:2] == ["null", "exact"] and kinds[-1] == "else"
    return plain and "jaro_winkler" in kinds and set(kinds[2:-1]) == {"jaro_winkler"}


def within_reach(pairs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Pairs that can still reach ``threshold`` before any similarity is measured.

    Equality, edit distance and length are JVM expressions; only pairs whose best case passes go on
    to the similarity measure, which runs in Python. No pair that reaches the threshold is lost.
    """
    cs = [filled(c) for c in model.comparisons]
    costly = [c for c in cs if _measured(c)]
    if not costly or not 0 < threshold < 1:
        return pairs
    cheap = [c for c in cs if not any(l.metric == "jaro_winkler" or l.metric is None for l in c.levels)]
    rest = [c for c in cs if c not in costly and c not in cheap]
    if rest:
        return pairs
    bounded = add_gammas(pairs, cheap)
    terms = [_weight(c) for c in cheap] + [t for c in cheap if (t := _tf_weight(c)) is not None]
    terms += [_best_weight(c) for c in costly]
    bound = reduce(lambda a, b: a + b, terms, F.lit(log_odds(model.prior)))
    return bounded.where(bound >= log_odds(threshold) - 1e-6).select(*pairs.columns)


def add_scores(pairs: DataFrame, model: Model) -> DataFrame:
    """Adds ``gamma_*``, ``bf_*`` (and ``bf_tf_*``), ``match_weight`` and ``match_probability``."""
    return _weighed(add_gammas(pairs, [filled(c) for c in model.comparisons]), model)


def _weighed(out: DataFrame, model: Model) -> DataFrame:
    """What :func:`add_scores` adds to pairs, or patterns of pairs, that have their levels."""
    cs = [filled(c) for c in model.comparisons]
    weights = {f"_w_{c.name}": _weight(c) for c in cs}
    weights |= {f"_t_{c.name}": t for c in cs if (t := _tf_weight(c)) is not None}
    out = out.withColumns(weights)
    total = reduce(lambda a, b: a + b, [F.col(w) for w in weights], F.lit(log_odds(model.prior)))
    out = out.withColumn("match_weight", total)
    out = out.withColumn("match_probability", _probability(F.col("match_weight")))
    factors = {}
    for c in cs:
        factors[f"bf_{c.name}"] = F.pow(F.lit(2.0), F.col(f"_w_{c.name}"))
        if f"_t_{c.name}" in weights:
            factors[f"bf_tf_{c.name}"] = F.pow(F.lit(2.0), F.col(f"_t_{c.name}"))
    return out.withColumns(factors).drop(*weights)


def _link_base(model: Model, df: DataFrame, other: DataFrame | None) -> DataFrame:
    cols = model.tf_columns
    if other is None or not cols:
        return df
    return df.select(*cols).unionAll(other.select(*cols))


def with_model_frequencies(
    model: Model, df: DataFrame, other: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    base = _link_base(model, df, other)
    todo = [c for c in model.tf_columns if f"tf_{c}" not in df.columns]
    left = with_term_frequencies(df, todo, base)
    return left, None if other is None else with_term_frequencies(other, todo, base)


#: Patterns are numbered by whole numbers below this.
MOST_PATTERNS = 1 << 62


def score_counts(
    df: DataFrame, model: Model, id_col: str, label: str, other: DataFrame | None = None, tile_rows: int = TILE_ROWS
) -> DataFrame | None:
    """(match_weight, label, pairs) of all pairs the rules bring together, counted by pattern; no row is made for a pair.

    Records are distinct, with ``copies``, ``tf_*`` and ids that are known and not repeated. ``label`` is 1 where the pair is
    equal in that column. None if levels or columns are of kinds that cannot be counted so.
    """
    cs = [filled(c) for c in model.comparisons]
    taken = {c.column for c in cs}
    cs += [exact_match(c) for c in dict.fromkeys([*[c for r in model.rules for c in r], label]) if c not in taken]
    rare = rare_exact(cs)
    right = df if other is None else other
    if rare is None or any(c.name != c.column for c in cs) or not all(can_tabulate(t, cs) for t in (df, right)):
        return None
    kinds = [F.count_distinct(f"tf_{c}") for c in rare]
    most = math.prod(len(c.scored) + 1 for c in cs)
    for t in (df, right) if rare else ():
        most *= math.prod(n + 1 for n in t.agg(*kinds).first())
    if most >= MOST_PATTERNS:
        return None
    need = list(dict.fromkeys([id_col, "copies", *[c.column for c in cs], *[f"tf_{c}" for c in rare]]))
    left, right = df.select(*need), right.select(*need)
    top = {c.column: len(c.scored) - 1 for c in cs}
    parts = []
    for k, rule in enumerate(model.rules):
        found = block_patterns(left, right, list(rule), cs, id_col, other is None, tile_rows, rare)
        for earlier in model.rules[:k]:
            found = found.where(~reduce(lambda a, b: a & b, [F.col(f"gamma_{c}") == top[c] for c in earlier]))
        parts.append(found)
    found = stage(reduce(DataFrame.unionAll, parts), "patterns")
    sides = {f"tf_{c}_{s}": F.col(f"tf_{c}") for c in rare for s in ("l", "r")}
    scored = _weighed(found.withColumns(sides) if sides else found, model)
    return scored.select("match_weight", (F.col(f"gamma_{label}") == top[label]).cast("int").alias("label"), F.col("n").alias("pairs"))


def _even(model: Model) -> bool:
    """True if no comparison can tell which record is on the left."""
    return all(l.metric is not None for c in model.comparisons for l in c.levels)


def predict(
    df: DataFrame,
    model: Model,
    id_col: str,
    other: DataFrame | None = None,
    threshold: float | None = None,
    retain_intermediate: bool = False,
    carry: list[str] | None = None,
    tile_rows: int = TILE_ROWS,
    distinct: bool = False,
) -> DataFrame:
    """Scores every pair the model's rules bring together; with ``threshold`` only pairs reaching it.

    A threshold also saves work: blocks above ``tile_rows`` are narrowed by what else a pair must
    agree on, and similarities are measured only where they can decide. The result is the same.
    Compared fields and term frequencies travel with the records through the blocking join, so the
    pairs themselves are never shuffled. ``carry`` names further record columns to keep. Records that
    hold ``tf_<col>`` already keep those. Equal records are scored once, as bundles, unless ``distinct`` says there are none, and that each has an id of its own;
    a table of bundles gives pairs of bundles.
    """
    df, other = with_model_frequencies(model, df, other)
    keep = list(dict.fromkeys([*model.columns, *[f"tf_{c}" for c in model.tf_columns], *(carry or [])]))
    if id_col != BUNDLE and not distinct and _even(model) and can_bundle(df, keep, id_col) and can_bundle(other, keep, id_col):
        left, right = (None if t is None else bundles(t, keep, id_col, other is not None) for t in (df, other))
        found, repeated = _predicted(left, model, BUNDLE, right, threshold, retain_intermediate, carry, keep, tile_rows)
        out = unfold(found, id_col, other is None)
        # where pairs found by several fields are told apart, those of repeated ids are too
        again = repeated and any(t is not None and not unique_ids(t, id_col) for t in (df, other))
        return out.dropDuplicates([f"{id_col}_l", f"{id_col}_r"]) if again else out
    return _predicted(df, model, id_col, other, threshold, retain_intermediate, carry, keep, tile_rows, distinct)[0]


def _predicted(
    df: DataFrame,
    model: Model,
    id_col: str,
    other: DataFrame | None,
    threshold: float | None,
    retain_intermediate: bool,
    carry: list[str] | None,
    keep: list[str],
    tile_rows: int,
    told: bool = False,
) -> tuple[DataFrame, bool]:
    """The scored pairs of records with term frequencies, and True if several fields found them."""
    repeated = False
    if threshold is None:
        pairs = block_rules(df, list(model.rules), id_col, other, keep, tile_rows)
    else:
        keep = [*keep, IDS] if id_col == BUNDLE else keep
        need = list(dict.fromkeys([id_col, *keep]))
        left = df.select(*need)
        right = left if other is None else other.select(*need)
        cs = [filled(c) for c in model.comparisons]
        gain = log_odds(threshold) - log_odds(model.prior) if 0 < threshold < 1 else -math.inf
        pairs, repeated = reaching_pairs(
            left, right, list(model.rules), cs, gain, id_col, other is None, keep, tile_rows, told
        )
        pairs = within_reach(pairs, model, threshold)
    scored = add_scores(pairs, model)
    if threshold is not None:
        scored = scored.where(F.col("match_probability") >= threshold)
    if repeated:
        # found by several fields; only pairs at the threshold are left here
        scored = scored.dropDuplicates([f"{id_col}_l", f"{id_col}_r"])
    cols = [f"{id_col}_l", f"{id_col}_r", "match_weight", "match_probability", "match_key"]
    cols += [f"{IDS}_{s}" for s in ("l", "r")] if id_col == BUNDLE else []
    cols += [f"{c}_{s}" for c in (carry or []) for s in ("l", "r")]
    if retain_intermediate:
        cols += [c for c in scored.columns if c.startswith(("gamma_", "bf_", "tf_"))]
    return scored.select(*cols), repeated


def preview(predictions: DataFrame, n: int, id_col: str) -> DataFrame:
    """First ``n`` predictions, strongest first."""
    order = [F.desc("match_weight"), F.asc(f"{id_col}_l"), F.asc(f"{id_col}_r")]
    return predictions.orderBy(*order).limit(n)


# ---- tables and storage -------------------------------------------------------------------------


def m_u_table(model: Model, spark: SparkSession) -> DataFrame:
    """One row per scored level: what the model holds (its size is that of the settings)."""
    rows = [
        (c.name, c.gamma_of(i), l.label, float(l.m), float(l.u))
        for c in (filled(c) for c in model.comparisons)
        for i, l in enumerate(c.scored)
    ]
    return spark.createDataFrame(
        rows, "comparison string, gamma int, label string, m_probability double, u_probability double"
    )


def match_weights_table(model: Model, spark: SparkSession) -> DataFrame:
    """log2(m/u) per level, and the prior as a row of its own."""
    levels = m_u_table(model, spark).select(
        "comparison", "gamma", "label", F.log2(F.col("m_probability") / F.col("u_probability")).alias("weight")
    )
    prior = spark.createDataFrame(
        [("prior", None, "prior", log_odds(model.prior))],
        "comparison string, gamma int, label string, weight double",
    )
    return levels.unionByName(prior)


def to_settings(model: Model) -> dict:
    """The model as settings in the stored shape: rules, comparisons, ordered levels, prior."""

    def level(l: Level) -> dict:
        out: dict = {"sql_condition": l.sql, "label_for_charts": l.label}
        if l.is_null:
            return out | {"is_null_level": True}
        if l.m is not None:
            out["m_probability"] = l.m
        if l.u is not None:
            out["u_probability"] = l.u
        if l.tf_column:
            out |= {"tf_adjustment_column": l.tf_column, "tf_adjustment_weight": l.tf_weight}
        return out

    return {
        "link_type": model.link_type,
        "blocking_rules_to_generate_predictions": [
            " AND ".join(f"l.{c} = r.{c}" for c in rule) for rule in model.rules
        ],
        "comparisons": [
            {
                "output_column_name": c.name,
                "comparison_levels": [level(l) for l in c.levels],
                "comparison_description": c.description,
            }
            for c in model.comparisons
        ],
        "probability_two_random_records_match": model.prior,
    }


_RULE_COLUMN = re.compile(r'\s*l\."?(\w+)"?\s*=\s*r\."?\1"?\s*', re.IGNORECASE)
_METRICS = (
    ("levenshtein", re.compile(r"^levenshtein\(.*\)\s*<=\s*(\d+)$")),
    ("jaro_winkler", re.compile(r"^jaro_winkler_similarity\(.*\)\s*>=\s*([\d.]+)$")),
)


def read_rule(text: str) -> Rule:
    """The columns of a stored rule, which must be equalities of one column each, joined by AND; anything else raises."""
    columns = []
    for part in re.split(r"\bAND\b", text, flags=re.IGNORECASE):
        found = _RULE_COLUMN.fullmatch(part)
        if not found:
            raise ValueError(f"a rule must be equalities of equally named columns joined by AND, not {text!r}")
        columns.append(found.group(1))
    return tuple(columns)


def from_settings(settings: dict) -> Model:
    """Reads stored settings. Probabilities are taken as they are, without rescaling them to sum to 1.

    A level whose condition is none of the known forms is evaluated as the SQL it is.
    """

    def level(name: str, d: dict) -> Level:
        sql = d["sql_condition"]
        metric, cut = None, None
        if d.get("is_null_level"):
            metric = "null"
        elif sql == "ELSE":
            metric = "else"
        elif sql == f'"{name}_l" = "{name}_r"':
            metric = "exact"
        for kind, shape in _METRICS:
            if (found := shape.match(sql)) and f'"{name}_l", "{name}_r"' in sql:
                metric, cut = kind, float(found.group(1))
        return Level(
            d.get("label_for_charts", ""),
            sql,
            metric,
            cut,
            d.get("m_probability"),
            d.get("u_probability"),
            bool(d.get("is_null_level")),
            d.get("tf_adjustment_column"),
            d.get("tf_adjustment_weight", 1.0),
        )

    return Model(
        tuple(
            Comparison(
                c["output_column_name"],
                tuple(level(c["output_column_name"], l) for l in c["comparison_levels"]),
                c.get("comparison_description", ""),
            )
            for c in settings["comparisons"]
        ),
        tuple(read_rule(r) for r in settings["blocking_rules_to_generate_predictions"]),
        settings.get("probability_two_random_records_match", DEFAULT_PRIOR),
        settings["link_type"],
    )


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    """One JSON text on any file system Spark can write."""
    row = [(json.dumps(to_settings(model), indent=2),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    register(spark)
    return from_settings(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def parameter_table(model: Model, spark: SparkSession) -> DataFrame:
    """The trained parameters as rows, e.g. to keep models side by side in a table."""
    rows = [
        (c.name, i, l.label, l.sql, l.m, l.u, l.tf_column, l.tf_weight if l.tf_column else None)
        for c in model.comparisons
        for i, l in enumerate(c.levels)
    ]
    return spark.createDataFrame(
        rows,
        "comparison string, position int, label string, sql_condition string, m_probability double, "
        "u_probability double, tf_adjustment_column string, tf_adjustment_weight double",
    )
