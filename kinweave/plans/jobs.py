"""The standard jobs: de-duplicate, link, correct addresses, correct providers, classify pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.privacy import encrypt_columns
from ..functions.text import clean_strings, mask_tail
from ..operators import candidates, classify, compare, correct, evaluate, geo, model as m, profiling
from ..operators.cluster import connected_components
from ..operators.ordering import add_row_id
from ..operators.skew import left_join_unique
from ..schema import ENCRYPTED, LABEL_COLUMN, PRESETS, LinkJob, has_labels
from ..session import scratch, stage, unstage
from ..sources.tables import read_jdbc, read_table
from .models import JOBS, JobModel

ID = "unique_id"


# ---- training -----------------------------------------------------------------------------------


def train(
    job: JobModel, df: DataFrame, id_col: str = ID, other: DataFrame | None = None, max_pairs: int = 1_000_000,
    profiles: tuple[DataFrame, DataFrame | None] | None = None,
) -> m.Model:
    """u from sampled pairs, the prior where the job asks for it, m from one EM run per training rule.

    ``profiles`` are the tables' distinct records with ``copies``, if the caller has them.
    """
    with scratch(df.sparkSession):
        model = m.estimate_u(job.model, df, id_col, max_pairs, other=other)
        if job.prior_rules:
            model = m.with_estimated_prior(model, df, list(job.prior_rules), id_col, other=other)
        left, right = profiles or (df, other)
        sessions = [m.estimate_m_em(model, left, rule, id_col, right, collapsed=bool(profiles)) for rule in job.training]
        return m.combine_sessions(model, sessions)


# ---- clustering records -------------------------------------------------------------------------


def _digest(cols: list[str]) -> Column:
    """Equal for two records exactly if all ``cols`` are equal (missing values included)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])), 256)


def profiles_of(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """One row per distinct record: its lowest id, its digest and its number of copies."""
    return (
        df.withColumn("profile", _digest(cols))
        .groupBy("profile", *cols)
        .agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))
    )


def _any_rule(rules) -> Column:
    def known(rule) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule])

    return reduce(lambda a, b: a | b, [known(r) for r in rules])


def score_copies(profiles: DataFrame, model: m.Model, carry: list[str] | None = None) -> DataFrame:
    """Each record with copies scored against itself, where a rule would bring the copies together."""
    both = profiles.where((F.col("copies") > 1) & _any_rule(model.rules))
    cols = [*model.columns, *[f"tf_{c}" for c in model.tf_columns], *(carry or [])]
    pairs = both.select(
        ID, "copies", *[F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys(cols) for s in ("l", "r")]
    )
    return m.add_scores(pairs, model)


def staged_profiles(df: DataFrame, other: DataFrame | None, cols: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The distinct records of both tables, written once for training and scoring."""
    return stage(profiles_of(df, cols, ID), "profiles"), None if other is None else stage(profiles_of(other, cols, ID), "profiles")


def cluster_records(
    df: DataFrame,
    model: m.Model,
    threshold: float,
    other: DataFrame | None = None,
    tile_rows: int = candidates.TILE_ROWS,
    profiles: tuple[DataFrame, DataFrame | None] | None = None,
) -> DataFrame:
    """Every record with the id of its cluster.

    Equal records are scored once: pairs are formed between distinct records, and whatever links a
    distinct record to another links all its copies. Copies without such a link are one cluster if a
    record of this content matches itself, and clusters of their own if not.
    """
    cols = model.columns
    with scratch(df.sparkSession) as made:
        merged = made.keep(_clusters_of_profiles(df, model, threshold, other, tile_rows, profiles))
    records = df if other is None else df.unionByName(other, allowMissingColumns=True)
    if other is not None:
        # the same content may occur in both tables, and both profiles then carry its cluster
        merged = merged.groupBy("profile").agg(F.max("_cluster").alias("_cluster"), F.sum("n").alias("n"))
    keyed = records.withColumn("profile", _digest(cols))
    joined = left_join_unique(
        keyed, merged.select("profile", "_cluster"), ["profile"], counts=merged.select("profile", "n")
    )
    return joined.select(*records.columns, F.coalesce("_cluster", ID).alias("cluster_id"))


def _clusters_of_profiles(df, model, threshold, other, tile_rows, profiles) -> DataFrame:
    """profile, _cluster and n (copies) of every distinct record, as a table."""
    left, right = profiles or staged_profiles(df, other, model.columns)
    base = df.select(*model.tf_columns) if model.tf_columns else df
    if other is not None and model.tf_columns:
        base = base.unionAll(other.select(*model.tf_columns))
    left = compare.with_term_frequencies(left, model.tf_columns, base)
    if right is not None:
        right = compare.with_term_frequencies(right, model.tf_columns, base)
    links = m.predict(left, model, ID, right, threshold=threshold, tile_rows=tile_rows, distinct=True)
    links = stage(links.select(f"{ID}_l", f"{ID}_r"), "links")
    found = stage(connected_components(links, f"{ID}_l", f"{ID}_r"), "components")

    every = left if right is None else left.unionByName(right)
    merged = every.select("profile", ID, "copies")
    merged = merged.join(found, merged[ID] == found["node"], "left").drop("node")
    if other is None:
        alike = score_copies(left, model).where(F.col("match_probability") >= threshold)
        merged = merged.join(alike.select(ID, F.lit(True).alias("_alike")), ID, "left")
    else:
        merged = merged.withColumn("_alike", F.lit(None).cast("boolean"))
    target = F.coalesce("component", F.when(F.col("_alike"), F.col(ID)))
    return stage(merged.select("profile", target.alias("_cluster"), F.col("copies").alias("n")), "merged")


def labelled_truth(
    df: DataFrame,
    model: m.Model,
    label: str = LABEL_COLUMN,
    other: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Truth table of the model against a label column, counting copies without pairing them.

    Every distinct weight is a threshold; ``digits`` rounds weights first, for a shorter table.
    """
    with scratch(df.sparkSession) as made:
        return made.keep(stage(_truth(df, model, label, other, digits), "truth"))


def _truth(df: DataFrame, model: m.Model, label: str, other: DataFrame | None, digits: int | None) -> DataFrame:
    cols = list(dict.fromkeys([*model.columns, label]))
    left = stage(profiles_of(df, cols, ID), "profiles")
    left = compare.with_term_frequencies(left, model.tf_columns, df)
    if other is not None:
        right = stage(profiles_of(other, cols, ID), "profiles")
        base = df.select(*cols).unionAll(other.select(*cols))
        left = compare.with_term_frequencies(left.select("profile", *cols, ID, "copies"), model.tf_columns, base)
        right = compare.with_term_frequencies(right, model.tf_columns, base)
    else:
        right = None
    same = F.coalesce(F.col(f"{label}_l") == F.col(f"{label}_r"), F.lit(False)).cast("int")
    score = F.col("match_weight") if digits is None else F.round("match_weight", digits).alias("match_weight")
    scored = m.score_counts(left, model, ID, label, right)
    if scored is None:
        scored = m.predict(left, model, ID, right, carry=[label, "copies"], distinct=True).select(
            "match_weight", same.alias("label"), (F.col("copies_l") * F.col("copies_r")).alias("pairs")
        )
    scored = scored.select(score, "label", "pairs")
    if other is None:
        own = score_copies(left, model, [label]).select(
            score, same.alias("label"), (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("pairs")
        )
        scored = scored.unionByName(own)
        missed = evaluate.true_pair_count(df, label)
    else:
        sizes = [t.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias(n)) for t, n in ((df, "a"), (other, "b"))]
        missed = sizes[0].join(sizes[1], label).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("true_pairs"))
    return evaluate.truth_table(stage(scored, "scored"), missed=missed, pairs="pairs")


# ---- the configured job -------------------------------------------------------------------------


@dataclass
class JobResult:
    """What a job gives. The truth table scores every candidate pair, so it is made when first asked for."""

    clusters: DataFrame
    model: m.Model
    missingness: DataFrame | None = None
    profile: DataFrame | None = None
    other_missingness: DataFrame | None = None
    other_profile: DataFrame | None = None
    measure: Callable[[], DataFrame] | None = None

    @cached_property
    def truth(self) -> DataFrame | None:
        """TP, FP, FN and TN per threshold; None without labels."""
        return self.measure() if self.measure else None

    def roc(self) -> DataFrame:
        return evaluate.roc_points(self.truth)

    def precision_recall(self) -> DataFrame:
        return evaluate.precision_recall_points(self.truth)


def _load(spark: SparkSession, job: LinkJob) -> list[DataFrame]:
    if job.source == "jdbc":
        return [read_jdbc(spark, table=t, **job.jdbc) for t in job.paths]
    fmt = None if job.source == "auto" else job.source
    schema = None
    if job.json_orient == "columns":  # column-oriented files need their columns named
        schema = T.StructType([*PRESETS[job.dataset], T.StructField(LABEL_COLUMN, T.StringType())])
    found = [
        read_table(spark, p, fmt, schema, json_orient=job.json_orient, multiline=job.multiline) for p in job.paths
    ]
    if schema is None:
        return found
    # a named column that no row holds is not a column of the file
    return [t.drop(LABEL_COLUMN) if t.where(F.col(LABEL_COLUMN).isNotNull()).isEmpty() else t for t in found]


def _prepared(df: DataFrame, job: LinkJob, gazetteer: DataFrame | None, start: int) -> DataFrame:
    """Preset columns in their types, optional place correction, cleaning, and a row id.

    Columns outside the preset stay as they are.
    """
    preset = {f.name: f for f in PRESETS[job.dataset]}
    if ID in df.columns:
        raise ValueError(f"the job names its records in {ID}: rename that column")
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in preset.values() if f.name in df.columns}
    if has_labels(df):
        typed[LABEL_COLUMN] = F.col(LABEL_COLUMN).cast("string")
    df = df.withColumns(typed)
    if job.geocoding:
        if gazetteer is None or not {"latitude", "longitude"} <= set(df.columns):
            raise ValueError("geocoding needs a gazetteer, and latitude and longitude in the table")
        fields = {c: g for c, g in geo.GEO_FIELDS[job.dataset].items() if c in df.columns}
        df = geo.reverse_geocode_fix(df, gazetteer, fields)
    others = [c for c in df.columns if c not in preset]
    df = clean_strings(df, skip=("latitude", "longitude", "rec_id", *others))
    with scratch(df.sparkSession) as made:
        if "rec_id" in df.columns:
            # repeated or missing record ids are told apart by a digest of the other columns
            told = df.withColumn("_digest", _digest([c for c in df.columns if c in preset and c != "rec_id"]))
            return made.keep(stage(add_row_id(told, ["rec_id", "_digest"], start, ID).drop("_digest"), "records"))
        # no natural key: ids follow the order of the rows in a table written once, so equal rows spread too
        lines = stage(df, "lines").withColumn("_line", F.monotonically_increasing_id())
        return made.keep(stage(add_row_id(lines, ["_line"], start, ID).drop("_line"), "records"))


def _complete(model: m.Model, df: DataFrame) -> None:
    missing = [c for c in model.columns if c not in df.columns]
    if missing:
        raise ValueError(f"the model needs columns {missing}")


def run_job(
    spark: SparkSession,
    job: LinkJob,
    gazetteer: DataFrame | None = None,
    key: bytes | None = None,
    job_model: JobModel | None = None,
) -> JobResult:
    """Load, correct, clean, profile, train, score, cluster and, with labels, evaluate.

    ``key`` encrypts the preset's personal columns in the result. ``job_model`` replaces the standard
    model of the data set and operation.
    """
    chosen = job_model or JOBS[(job.dataset, job.operation)]()
    loaded = _load(spark, job)
    tables = [_prepared(loaded[0], job, gazetteer, 1)]
    if len(loaded) == 2:
        first = tables[0].count() + 1
        tables.append(_prepared(loaded[1], job, gazetteer, first))
    for t in tables:
        _complete(chosen.model, t)
    df, other = tables[0], tables[1] if len(tables) == 2 else None

    views = []
    for t in tables if job.profile else []:
        cols = [c for c in t.columns if c != ID]
        hidden = mask_tail(t.select(*cols))
        views += [profiling.missingness(hidden), profiling.profile_columns(hidden, cols)]
    views += [None] * (4 - len(views))

    threshold = job.cluster_threshold if job_model is None else chosen.threshold
    profiles = staged_profiles(df, other, chosen.model.columns)
    model = train(chosen, df, ID, other, profiles=profiles)
    if other is not None:
        df = df.withColumn("source_dataset", F.lit("left"))
        other = other.withColumn("source_dataset", F.lit("right"))
    clusters = cluster_records(df, model, threshold, other, profiles=profiles)
    for made in profiles:
        if made is not None:
            unstage(made)
    measure = None
    if all(has_labels(t) for t in tables):
        measure = partial(labelled_truth, df, model, LABEL_COLUMN, other)
    if key is not None:
        clusters = encrypt_columns(clusters, [c for c in ENCRYPTED[job.dataset] if c in clusters.columns], key)
    return JobResult(clusters, model, *views, measure)


# ---- address and provider jobs ------------------------------------------------------------------


def address_job(
    df: DataFrame,
    cities: DataFrame,
    abbreviations: DataFrame,
    vectors: DataFrame,
    id_col: str,
    rejected: DataFrame | None = None,
    threshold: float = 0.75,
) -> DataFrame:
    """Correct city and state, expand abbreviations, join the parts and group near-equal addresses.

    ``cities`` has city, state_id, city_state and ref_order; ``vectors`` has the id and ``embedding``.
    """
    unknown = correct.unknown_city_or_state(df, cities)
    suggestions = stage(correct.suggest_corrections(unknown, cities), "suggestions")
    fixed = correct.apply_corrections(df, suggestions, rejected)
    fixed = correct.expand_abbreviations(fixed, abbreviations, "address", id_col)
    fixed = fixed.withColumn("single_address", correct.single_address(["address", "city", "state", "zip"]))
    ready = stage(fixed.join(vectors.select(id_col, "embedding"), id_col, "left"), "addresses")
    return correct.cluster_addresses(ready, "single_address", "embedding", id_col, threshold).drop("embedding")


def provider_job(
    df: DataFrame, vocabulary: DataFrame, id_col: str, rejected: DataFrame | None = None, col: str = "Provider_Name", bundled: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Spell-corrected names (but for rejected ones), and the near duplicates among them.

    With ``bundled`` these are pairs of bundles of equal names, unless ids are missing or repeated.
    """
    spelled = stage(correct.spell_correct(df, vocabulary, col, id_col, leading_space=False), "spelled")
    # one suggestion per distinct name: equal names are corrected alike
    found = spelled.groupBy(F.col(col).alias("original")).agg(F.min("Filtered_Name").alias("suggested"))
    fixed = stage(correct.apply_provider_corrections(df, found, rejected, col), "providers")
    if bundled and candidates.known_ids(fixed, id_col):
        return fixed, correct.provider_near_duplicates(candidates.bundles(fixed, [col], id_col), col, candidates.BUNDLE)
    return fixed, correct.provider_near_duplicates(fixed, col, id_col)


# ---- supervised classification ------------------------------------------------------------------


def classify_pairs(
    df: DataFrame,
    truth: DataFrame,
    features: list[compare.Feature],
    block_on: list[str],
    neighbours_on: str,
    id_col: str = ID,
    trees: int = classify.TREES,
) -> tuple[DataFrame, PipelineModel]:
    """Candidates from a block key and a sorted neighbourhood; features; labels; fit; predict.

    Returns every candidate pair with features, label, split and prediction, and the fitted model.
    """
    cols = list(dict.fromkeys(f.column for f in features))
    keys = [f"{id_col}_l", f"{id_col}_r"]
    # where every record has an id of its own, its fields and true links travel with it, and no pair is shuffled
    linked = evaluate.with_links(df, truth, id_col) if candidates.known_ids(df, id_col) else None
    if linked is not None:
        kept = list(dict.fromkeys([*cols, *block_on, evaluate.LINKS]))
        pairs = candidates.union_candidates(
            candidates.block(linked, block_on, id_col, keep=kept),
            candidates.sorted_neighbourhood(linked, neighbours_on, id_col, keep=kept),
            told=block_on,
        )
    else:
        pairs = candidates.union_candidates(
            candidates.block(df, block_on, id_col), candidates.sorted_neighbourhood(df, neighbours_on, id_col)
        )
    filled = candidates.attach_records(pairs, df.select(id_col, *cols), id_col)
    vectors = compare.compute_features(filled, features, keys if linked is None else [*keys, f"{evaluate.LINKS}_l"])
    # features are worked out once; digests are as long as all else and worked out each time the split reads them
    labelled = stage(evaluate.label_pairs(vectors, truth, *keys), "labelled")
    split = evaluate.stratified_split(labelled, "label", keys)
    fitted = classify.fit_pair_classifier(split.where("is_test = 0"), [f.name for f in features], trees=trees)
    return classify.predict_pairs(fitted, split), fitted
