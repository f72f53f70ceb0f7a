"""Address and provider correction against reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import edit_ratio, digit_tokens
from ..session import broadcast_if_small, is_small, stage
from .candidates import BUNDLE, bundles, can_bundle, known_ids, sorted_neighbourhood, unfold
from .cluster import connected_components
from .fuzzyjoin import cosine_join, edit_join
from .ordering import dense_positions
from .skew import left_join_unique

NOTHING_FOUND = "Nothing Found"  # fixed value


def city_state_key(city: str = "city", state: str = "state") -> Column:
    """``city,state``; missing if either part is missing."""
    known = F.col(city).isNotNull() & F.col(state).isNotNull()
    return F.when(known, F.concat_ws(",", city, state))


def single_address(cols: list[str]) -> Column:
    """The parts as one comma-joined text, missing parts left out."""
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def unknown_city_state(df: DataFrame, ref: DataFrame, key: str = "city_state") -> DataFrame:
    """Distinct keys of ``df`` that the reference does not hold."""
    seen = df.select(key).where(F.col(key).isNotNull()).distinct()
    return seen.join(broadcast_if_small(ref.select(key).distinct()), key, "left_anti")


def unknown_city_or_state(
    df: DataFrame, ref: DataFrame, city: str = "city", state: str = "state", ref_state: str = "state_id"
) -> DataFrame:
    """Distinct city/state combinations whose city or whose state the reference does not hold."""
    seen = stage(df.select(city, state).dropna().distinct(), "keys")
    cities = broadcast_if_small(ref.select(F.col(city)).distinct())
    states = broadcast_if_small(ref.select(F.col(ref_state).alias(state)).distinct())
    bad = seen.join(cities, city, "left_anti").unionByName(seen.join(states, state, "left_anti"))
    return bad.distinct().select(F.concat_ws(",", city, state).alias("city_state"))


def suggest_corrections(
    unknown: DataFrame, ref: DataFrame, max_distance: int = 3, key: str = "city_state", order: str = "ref_order"
) -> DataFrame:
    """Nearest reference key below ``max_distance`` edits; the first in reference order wins ties."""
    l = stage(unknown.select(F.col(key).alias("text"), F.xxhash64(key).alias("id")).distinct(), "keys")
    r = stage(ref.select(F.col(key).alias("text"), F.col(order).alias("id")), "reference")
    near = edit_join(l, r, "text", "id", max_distance - 1)
    best = near.groupBy("text_l").agg(F.min(F.struct("edits", "id_r", "text_r")).alias("b"))
    return best.select(
        F.col("text_l").alias("original"), F.col("b.text_r").alias("suggested"), F.col("b.edits").alias("edits")
    )


def suggest_by_embedding(
    unknown: DataFrame, ref: DataFrame, threshold: float = 0.80, id_col: str = "id", vec: str = "vector", name: str = "name"
) -> DataFrame:
    """Nearest reference entry by cosine, or a fixed text where none reaches ``threshold``."""
    near = cosine_join(unknown, ref, vec, id_col, threshold, best=True)
    # the best entry, the least id among equally good ones; ids may be of any type that can be ordered
    order = F.struct((-F.col("cosine")).alias("less"), F.col(f"{id_col}_r").alias("ref"), "cosine")
    best = near.groupBy(F.col(f"{id_col}_l").alias(id_col)).agg(F.min(order).alias("b"))
    best = best.select(id_col, F.col("b.cosine").alias("cosine"), F.col("b.ref").alias("_ref"))
    named = best.join(ref.select(F.col(id_col).alias("_ref"), F.col(name).alias("suggested")), "_ref").drop("_ref")
    return unknown.select(id_col).join(named, id_col, "left").withColumn(
        "suggested", F.coalesce("suggested", F.lit(NOTHING_FOUND))
    )


def _accepted(suggestions: DataFrame, rejected: DataFrame | None) -> DataFrame:
    if rejected is None:
        return suggestions
    return suggestions.join(broadcast_if_small(rejected.select("original").distinct()), "original", "left_anti")


def apply_corrections(
    df: DataFrame,
    suggestions: DataFrame,
    rejected: DataFrame | None = None,
    city: str = "city",
    state: str = "state",
) -> DataFrame:
    """Write the suggested city and state wherever both match the original and it was not rejected."""
    good = _accepted(suggestions, rejected).select(F.col("original").alias("_key"), "suggested")
    joined = left_join_unique(df.withColumn("_key", city_state_key(city, state)), good, ["_key"])
    parts = F.split("suggested", ",")
    found = F.col("suggested").isNotNull()
    new = {
        city: F.when(found, F.element_at(parts, 1)).otherwise(F.col(city)),
        state: F.when(found, F.element_at(parts, 2)).otherwise(F.col(state)),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def apply_provider_corrections(
    df: DataFrame, suggestions: DataFrame, rejected: DataFrame | None = None, col: str = "Provider_Name"
) -> DataFrame:
    """Replace every occurrence of a corrected name unless its correction was rejected."""
    good = _accepted(suggestions, rejected).select(F.col("original").alias(col), "suggested")
    joined = left_join_unique(df, good, [col])
    return joined.select(
        *[F.coalesce("suggested", F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns]
    )


# ---- tokens -------------------------------------------------------------------------------------


def replace_tokens(df: DataFrame, mapping: DataFrame, col: str, id_col: str, fold: bool = False) -> DataFrame:
    """Replace whole space-separated tokens of ``col`` by ``mapping`` (token, replacement).

    A mapping shown to be small becomes one map value next to each row, with no shuffle. A large one
    is joined to the distinct tokens of each row, and rows get their own few replacements back.
    ``fold`` looks tokens up in lower case. A token given several replacements takes the first in text order.
    """

    def look(token: Column) -> Column:
        return F.lower(token) if fold else token

    tokens = F.split(F.col(col), " ")
    mapping = mapping.select("token", "replacement").dropna()
    mapping = stage(mapping.groupBy("token").agg(F.min("replacement").alias("replacement")), "mapping")
    if is_small(mapping):
        # a single value, behind the size check
        entries = F.collect_list(F.struct("token", "replacement"))
        with_map = df.withColumn("_map", mapping.agg(F.map_from_entries(entries)).scalar())
    else:
        pieces = df.select(id_col, F.explode(F.array_distinct(F.transform(tokens, look))).alias("token"))
        found = left_join_unique(pieces, mapping, ["token"]).where(F.col("replacement").isNotNull())
        # the entries of one row are bounded by the row's own tokens
        own = found.groupBy(id_col).agg(
            F.map_from_entries(F.collect_list(F.struct("token", "replacement"))).alias("_map")
        )
        with_map = df.join(own, id_col, "left")
    filled = F.coalesce(F.col("_map"), F.create_map().cast("map<string,string>"))
    swapped = F.array_join(
        F.transform(tokens, lambda t: F.coalesce(F.try_element_at(filled, look(t)), t)), " "
    )
    return with_map.select(*[swapped.alias(c) if c == col else F.col(c) for c in df.columns])


def expand_abbreviations(df: DataFrame, abbreviations: DataFrame, col: str, id_col: str) -> DataFrame:
    """Whole address tokens by their expansions; ``abbreviations`` has the two published column names."""
    mapping = abbreviations.select(
        F.col("Abbreviations").alias("token"), F.col("Corrected_Abbreviations").alias("replacement")
    )
    return replace_tokens(df, mapping, col, id_col)


def word_candidates(df: DataFrame, vocabulary: DataFrame, col: str, distance: int = 2, keep_up_to: int = 3) -> DataFrame:
    """Every vocabulary word within ``distance`` edits of each unknown token: (token, word, edits, frequency)."""
    tokens = (
        df.select(F.explode(F.split(F.lower(F.col(col)), " ")).alias("text"))
        .where(F.length("text") > keep_up_to)
        .distinct()
    )
    # both are read several times from here on
    words = stage(vocabulary.select(F.col("word").alias("text"), "frequency"), "vocabulary")
    checked = F.broadcast if is_small(words) else (lambda side: side)
    unknown = tokens.join(checked(words.select("text")), "text", "left_anti")
    unknown = stage(unknown.withColumn("id", F.xxhash64("text")), "tokens")
    near = edit_join(unknown, words.select("text", F.xxhash64("text").alias("id")), "text", "id", distance)
    return near.join(checked(words.withColumnRenamed("text", "text_r")), "text_r").select(
        F.col("text_l").alias("token"), F.col("text_r").alias("word"), "edits", "frequency"
    )


def best_words(candidates: DataFrame) -> DataFrame:
    """The nearest word per token; among equally near ones the most frequent, then the first by name."""
    best = candidates.groupBy("token").agg(
        F.min(F.struct("edits", (-F.col("frequency")).alias("f"), "word")).alias("b")
    )
    return best.select("token", F.col("b.word").alias("replacement"))


def spell_correct(
    df: DataFrame, vocabulary: DataFrame, col: str, id_col: str, out: str = "Filtered_Name", leading_space: bool = True
) -> DataFrame:
    """Short and known tokens stay, others become the best vocabulary word; the result is upper case.

    Each corrected token is preceded by a space, so the text starts with one unless told otherwise.
    """
    fixes = stage(best_words(word_candidates(df, vocabulary, col)), "words")
    fixed = replace_tokens(df.withColumn(out, F.col(col)), fixes, out, id_col, fold=True)
    text = F.upper(F.col(out))
    return fixed.withColumn(out, F.concat(F.lit(" "), text) if leading_space else text)


def correction_ratio(original: str, corrected: str) -> Column:
    return edit_ratio(F.col(original), F.col(corrected))


# ---- near duplicates ----------------------------------------------------------------------------


def provider_near_duplicates(
    df: DataFrame, col: str, id_col: str, window: int = 5, threshold: float = 0.80
) -> DataFrame:
    """Sorted-neighbourhood pairs whose names are at least ``threshold`` alike. Bundles give pairs of bundles."""
    if id_col != BUNDLE and can_bundle(df, [col], id_col) and known_ids(df, id_col):
        return unfold(provider_near_duplicates(bundles(df, [col], id_col), col, BUNDLE, window, threshold), id_col)
    pairs = sorted_neighbourhood(df, col, id_col, window, keep=[col])
    scored = pairs.withColumn("score", edit_ratio(F.col(f"{col}_l"), F.col(f"{col}_r")))
    return scored.where(F.col("score") >= threshold)


def cluster_addresses(
    df: DataFrame, text: str, vec: str, id_col: str, threshold: float = 0.75
) -> DataFrame:
    """Group number per address: same numbers in the text and cosine at least ``threshold``; 0 = none.

    Equal numbers are an equality key of the join, as a digest that is checked on the records, or on the joined rows where two texts share one. Groups are
    connected components, named by their least id plus one, or, where ids are not whole numbers, numbered from 1 in the
    order of their least ids. A missing text or id has no group.
    """
    numbers = F.array_join(digit_tokens(F.col(text)), " ")
    keyed = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull())
    keyed = stage(keyed.select(id_col, vec, F.xxhash64(numbers).alias("_numbers"), numbers.alias("_text")), "numbers")
    near = cosine_join(keyed.drop("_text"), keyed.drop("_text"), vec, id_col, threshold, ["_numbers"], same=True)
    # where each digest is that of one text only, the pairs need no check
    texts = keyed.groupBy("_numbers").agg(F.min("_text").alias("first"), F.max("_text").alias("last"))
    if not texts.where("first <> last").isEmpty():
        own = keyed.select(id_col, "_text")
        for side in ("l", "r"):
            near = near.join(own.withColumnsRenamed({c: f"{c}_{side}" for c in own.columns}), f"{id_col}_{side}")
        near = near.where("_text_l = _text_r")
    found = stage(connected_components(near, f"{id_col}_l", f"{id_col}_r"), "components")
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        numbered = found.withColumn("group_id", F.col("component") + 1)
    else:
        numbered = found.join(dense_positions(found, "component", "group_id"), "component")
    groups = numbered.select(F.col("node").alias(id_col), F.col("group_id").cast("long").alias("group_id"))
    joined = left_join_unique(df, groups, [id_col])
    return joined.select(*df.columns, F.coalesce("group_id", F.lit(0).cast("long")).alias("group_id"))
