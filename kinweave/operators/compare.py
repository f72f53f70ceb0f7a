"""Comparisons: ordered levels per field, and the level (gamma) a pair of records reaches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler, length_allows
from ..functions.text import edit_ratio
from ..session import stage
from .skew import left_join_unique

# fixed values: the two similarity cuts of a name comparison
NAME_CUTS = (0.95, 0.88)


@dataclass(frozen=True)
class Level:
    """One level: its condition on ``<col>_l`` and ``<col>_r``, and what the model learnt about it."""

    label: str
    sql: str
    metric: str | None = None
    cut: float | None = None
    m: float | None = None
    u: float | None = None
    is_null: bool = False
    tf_column: str | None = None
    tf_weight: float = 1.0


@dataclass(frozen=True)
class Comparison:
    """Levels from strictest to loosest; the first may be the null level, the last is the rest."""

    name: str
    levels: tuple[Level, ...]
    description: str = ""

    @property
    def scored(self) -> tuple[Level, ...]:
        return tuple(l for l in self.levels if not l.is_null)

    @property
    def column(self) -> str:
        return self.name

    def gamma_of(self, position: int) -> int:
        """Gamma of the scored level at ``position``: the strictest level has the highest number."""
        return len(self.scored) - 1 - position

    @property
    def tf_columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(l.tf_column for l in self.levels if l.tf_column))

    def with_probabilities(self, m: dict[int, float] | None = None, u: dict[int, float] | None = None):
        """A copy with m and u replaced for the given gammas."""
        out, at = [], 0
        for l in self.levels:
            if not l.is_null:
                g = self.gamma_of(at)
                at += 1
                l = replace(l, m=(m or {}).get(g, l.m), u=(u or {}).get(g, l.u))
            out.append(l)
        return replace(self, levels=tuple(out))


def _sides(col: str) -> tuple[str, str]:
    return f'"{col}_l"', f'"{col}_r"'


def _null_level(col: str) -> Level:
    a, b = _sides(col)
    return Level("Null", f"{a} IS NULL OR {b} IS NULL", metric="null", is_null=True)


def _exact_level(col: str, tf: bool) -> Level:
    a, b = _sides(col)
    return Level("Exact match", f"{a} = {b}", metric="exact", tf_column=col if tf else None)


def _else_level() -> Level:
    return Level("All other comparisons", "ELSE", metric="else")


def exact_match(col: str, tf: bool = False) -> Comparison:
    return Comparison(col, (_null_level(col), _exact_level(col, tf), _else_level()), "exact match")


def levenshtein_at(col: str, cuts: int | list[int], tf: bool = False) -> Comparison:
    a, b = _sides(col)
    cuts = [cuts] if isinstance(cuts, int) else list(cuts)
    levels = [
        Level(f"Levenshtein <= {t}", f"levenshtein({a}, {b}) <= {t}", metric="levenshtein", cut=t)
        for t in sorted(cuts)
    ]
    return Comparison(
        col, (_null_level(col), _exact_level(col, tf), *levels, _else_level()), f"edit distance {cuts}"
    )


def jaro_winkler_at(col: str, cuts: list[float], tf: bool = False) -> Comparison:
    a, b = _sides(col)
    levels = [
        Level(
            f"Jaro_winkler_similarity >= {t}",
            f"jaro_winkler_similarity({a}, {b}) >= {t}",
            metric="jaro_winkler",
            cut=t,
        )
        for t in sorted(cuts, reverse=True)
    ]
    return Comparison(
        col, (_null_level(col), _exact_level(col, tf), *levels, _else_level()), f"similarity {cuts}"
    )


def name_comparison(col: str, tf: bool = False) -> Comparison:
    return jaro_winkler_at(col, list(NAME_CUTS), tf)


def _similarity_column(c: Comparison) -> str:
    return f"_sim_{c.name}"


def _similarity(c: Comparison) -> Column | None:
    """Jaro-Winkler only where it can decide a level: not equal, and lengths close enough."""
    cuts = [l.cut for l in c.levels if l.metric == "jaro_winkler"]
    if not cuts:
        return None
    a, b = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
    open_ = (a != b) & length_allows(a, b, min(cuts))
    return jaro_winkler(F.when(open_, a), F.when(open_, b))


def _level_test(c: Comparison, l: Level) -> Column:
    a, b = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
    if l.metric == "null":
        return a.isNull() | b.isNull()
    if l.metric == "exact":
        return a == b
    if l.metric == "levenshtein":
        # the bounded form gives -1 above its bound
        return F.levenshtein(a, b, int(l.cut)).between(0, int(l.cut))
    if l.metric == "jaro_winkler":
        return F.coalesce(F.col(_similarity_column(c)) >= l.cut, F.lit(False))
    return F.expr(l.sql.replace('"', "`"))


def _gamma(c: Comparison) -> Column:
    out = None
    at = 0
    for l in c.levels:
        value = -1
        if not l.is_null:
            value = c.gamma_of(at)
            at += 1
        if l.sql == "ELSE":
            continue
        test = _level_test(c, l)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(0)).cast("int").alias(f"gamma_{c.name}")


def add_gammas(pairs: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Adds ``gamma_<name>`` per comparison: -1 for a missing side, else 0 (worst) upwards.

    Similarities are computed in one projection and tested in the next, so each is evaluated once.
    """
    sims = {
        _similarity_column(c): s for c in comparisons if (s := _similarity(c)) is not None
    }
    staged = pairs.withColumns(sims) if sims else pairs
    return staged.select(*pairs.columns, *[_gamma(c) for c in comparisons])


# ---- thresholded 0/1 features -------------------------------------------------------------------


@dataclass(frozen=True)
class Feature:
    """One pair feature: ``exact`` or ``jarowinkler`` as 0/1, ``levenshtein`` as a share unless cut."""

    column: str
    method: str = "levenshtein"
    threshold: float | None = None
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or self.column


def feature(f: Feature) -> Column:
    a, b = F.col(f"{f.column}_l"), F.col(f"{f.column}_r")
    if f.method == "exact":
        return F.coalesce(a == b, F.lit(False)).cast("int").alias(f.name)
    if f.method == "jarowinkler":
        if f.threshold is not None:
            open_ = (a != b) & length_allows(a, b, f.threshold)
            score = F.when(a == b, F.when(F.length(a) == 0, 0.0).otherwise(1.0)).otherwise(
                jaro_winkler(F.when(open_, a), F.when(open_, b))
            )
        else:
            score = jaro_winkler(a, b)
    elif f.method == "levenshtein":
        score = edit_ratio(a, b)
    else:
        raise ValueError(f"unknown method {f.method}")
    if f.threshold is None:
        return F.coalesce(score, F.lit(0.0)).alias(f.name)
    return F.when(score >= f.threshold, 1).otherwise(0).alias(f.name)


def compute_features(pairs: DataFrame, features: list[Feature], keys: list[str]) -> DataFrame:
    """All features of a pair table that already carries both sides' fields."""
    return pairs.select(*keys, *[feature(f) for f in features])


def rule_sum_classifier(features: DataFrame, names: list[str], minimum: int = 5, out: str = "predict") -> DataFrame:
    """1 where at least ``minimum`` of the 0/1 features are set."""
    total = sum((F.col(n) for n in names), F.lit(0))
    return features.withColumn(out, F.when(total >= minimum, 1).otherwise(0))


def mean_score(features: DataFrame, names: list[str], out: str = "score") -> DataFrame:
    total = sum((F.col(n) for n in names), F.lit(0))
    return features.withColumn(out, total / F.lit(float(len(names))))


# ---- term frequencies ---------------------------------------------------------------------------


def term_frequency(df: DataFrame, col: str) -> DataFrame:
    """Share of each value among the non-null values: (value, n, tf)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(col)).scalar()
    return counts.select(F.col(col), "n", (F.col("n") / total).alias(f"tf_{col}"))


def with_term_frequencies(df: DataFrame, cols: list[str], base: DataFrame | None = None) -> DataFrame:
    """Adds ``tf_<col>`` to each record (before pairing, so it travels with the record).

    Frequencies come from ``base`` (default ``df``), e.g. the union of both tables of a link.
    """
    for c in cols:
        table = stage(term_frequency(base if base is not None else df, c), "tf")
        df = left_join_unique(df, table.select(c, f"tf_{c}"), [c], counts=table.select(c, "n"))
    return df
