"""Measuring predicted links against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .candidates import canonical_pairs, spread
from .ordering import add_row_id, running_totals
from .skew import left_join_unique


#: A confusion matrix has a column for each class.
MOST_CLASSES = 1000
#: Hexadecimal digits of a digest by which the rows of a label are counted.
LEAD = 4
#: True links of a record that may travel with it.
MOST_LINKS = 256
LINKS = "_links"


def with_links(df: DataFrame, truth: DataFrame, id_col: str) -> DataFrame | None:
    """The records with the higher ids each is truly linked with, so that pairs of them are labelled without a join; None if one has very many.

    ``truth`` has ``<id>_l`` and ``<id>_r`` in either direction.
    """
    left, right = f"{id_col}_l", f"{id_col}_r"
    kind = df.schema[id_col].dataType
    higher = canonical_pairs(truth.select(F.col(left).cast(kind), F.col(right).cast(kind)), left, right).distinct()
    if not higher.groupBy(left).count().where(F.col("count") > MOST_LINKS).isEmpty():
        return None
    links = stage(higher.groupBy(F.col(left).alias(id_col)).agg(F.collect_list(right).alias(LINKS)), "links")
    return stage(left_join_unique(df, links, [id_col]), "linked")


def label_pairs(
    pairs: DataFrame, truth: DataFrame, left: str, right: str, out: str = "label", alike: bool = False
) -> DataFrame:
    """1 where the pair is a true link in either direction, else 0. With ``alike`` (bundles) a row may be linked with itself.

    Pairs of :func:`with_links`, lower id left, carry the links.
    """
    if f"{LINKS}_l" in pairs.columns:
        true = F.array_contains(f"{LINKS}_l", F.col(right))
        return pairs.withColumn(out, F.coalesce(true, F.lit(False)).cast("int")).drop(f"{LINKS}_l", f"{LINKS}_r")
    links = truth.select(F.least(left, right).alias(left), F.greatest(left, right).alias(right)) if alike else canonical_pairs(truth, left, right)
    true = links.distinct().withColumn(out, F.lit(1))
    keyed = pairs.withColumns(
        {"_lo": F.least(left, right), "_hi": F.greatest(left, right)}
    )
    true = true.withColumnsRenamed({left: "_lo", right: "_hi"})
    if alike:
        keyed, true = spread(keyed, ["_lo", "_hi"]), spread(true, ["_lo", "_hi"])
    return keyed.join(true, ["_lo", "_hi"], "left").fillna(0, [out]).drop("_lo", "_hi")


def _number(pairs: str | None):
    """How many pairs the rows stand for: one each, or what the column ``pairs`` says."""
    return F.count(F.lit(1)) if pairs is None else F.sum(pairs)


def label_counts(labelled: DataFrame, label: str = "label", pairs: str | None = None) -> DataFrame:
    return labelled.groupBy(label).agg(_number(pairs).alias("pairs"))


def true_pair_count(df: DataFrame, cluster: str) -> DataFrame:
    """One row: pairs inside true clusters, counted from the cluster sizes."""
    n = F.count(F.lit(1))
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg((n * (n - 1) / 2).cast("long").alias("k"))
    return sizes.agg(F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("true_pairs"))


def truth_table(
    scored: DataFrame,
    score: str = "match_weight",
    label: str = "label",
    missed: DataFrame | None = None,
    pairs: str | None = None,
) -> DataFrame:
    """TP, FP, FN and TN when everything at or above each distinct score is called a match.

    ``missed`` is one row with ``true_pairs``: all true links, so that links no rule proposed count
    as false negatives. ``pairs`` names a column saying how many pairs a row stands for. Scores are
    counted first; the running sums go over distinct scores only.
    """
    each = F.col(pairs) if pairs else F.lit(1)
    yes = F.sum(F.when(F.col(label) == 1, each).otherwise(0)).cast("long")
    no = F.sum(F.when(F.col(label) == 1, 0).otherwise(each)).cast("long")
    per_score = scored.groupBy(F.col(score).alias("threshold")).agg(yes.alias("_p"), no.alias("_n"))
    per_score = stage(per_score, "per-score")
    summed = running_totals(per_score, "threshold", {"tp": "_p", "fp": "_n"}, descending=True)
    all_yes = (per_score.agg(F.sum("_p")) if missed is None else missed.select("true_pairs")).scalar()
    all_no = per_score.agg(F.sum("_n")).scalar()
    return summed.select(
        "threshold",
        "tp",
        "fp",
        (all_yes - F.col("tp")).alias("fn"),
        (all_no - F.col("fp")).alias("tn"),
    )


def _ratio(a, b):
    return F.when(b > 0, a / b)


def roc_points(table: DataFrame) -> DataFrame:
    """False and true positive rate per threshold."""
    c = F.col
    return table.select(
        "threshold",
        _ratio(c("fp"), c("fp") + c("tn")).alias("fpr"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("tpr"),
    )


def precision_recall_points(table: DataFrame) -> DataFrame:
    c = F.col
    return table.select(
        "threshold",
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
    )


def key_digest(keys: list[str], seed: int) -> Column:
    """The digest of a row's keys that :func:`stratified_split` orders by."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def stratified_split(
    df: DataFrame, label: str, keys: list[str], test_share: float = 0.1, seed: int = 10, out: str = "is_test", digest: Column | None = None
) -> DataFrame:
    """Marks ``test_share`` of the rows of each label (nearest count) in a keyed digest order.

    The rows are not sorted. Counts by label and lead of the digest show under which lead the last marked row of a label
    lies; rows under a lower or higher one are marked as they are, and only those under this lead, one in 65,536, are put in
    order. Rows without a label stay, with a missing mark. ``df`` is read several times and must give the same rows each time.
    ``digest`` may be a column that already holds the digest, or a cheaper one of 64 bits in place of the text.
    """
    led = df.withColumn("_digest", key_digest(keys, seed) if digest is None else digest)
    whole = isinstance(led.schema["_digest"].dataType, T.LongType)
    led = led.withColumn("_lead", F.shiftright("_digest", 64 - 4 * LEAD) if whole else F.left("_digest", F.lit(LEAD)))
    counts = led.where(F.col(label).isNotNull()).groupBy(label, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    # a label has at most 16^LEAD leads
    own = Window.partitionBy(label)
    counts = counts.withColumns({"_upto": F.sum("_n").over(own.orderBy("_lead")), "_all": F.sum("_n").over(own)})
    wanted = F.floor(F.col("_all") * test_share + 0.5)
    last = F.min(F.when(F.col("_upto") >= wanted, F.struct("_lead", (wanted - F.col("_upto") + F.col("_n")).alias("wanted"))))
    cuts = counts.groupBy(label).agg(last.alias("_last"), F.sum("_n").alias("n"))
    cuts = stage(cuts.select(label, F.col("_last._lead").alias("_cut"), F.col("_last.wanted").alias("_wanted"), "n"), "cuts")
    met = left_join_unique(led, cuts.drop("n"), [label], counts=cuts.select(label, "n"))
    open_ = F.coalesce(F.col("_lead") == F.col("_cut"), F.lit(False))
    # a label without a cut is marked whole
    test = F.when(F.col(label).isNotNull(), F.coalesce(F.col("_lead") < F.col("_cut"), F.lit(True)).cast("int"))
    sure = met.where(~open_).select(*df.columns, test.alias(out))
    placed = add_row_id(met.where(open_), [label, "_digest", *keys], 1, "_pos")
    first = placed.groupBy(label).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("n"))
    first = stage(first, "firsts")
    ranked = left_join_unique(placed, first.drop("n"), [label], counts=first.select(label, "n"))
    rank = F.col("_pos") - F.col("_first") + 1
    return sure.unionAll(ranked.select(*df.columns, (rank <= F.col("_wanted")).cast("int").alias(out)))


def accuracy(df: DataFrame, label: str = "label", predict: str = "predict", pairs: str | None = None) -> DataFrame:
    hit = (F.col(label) == F.col(predict)).cast("int")
    if pairs is None:
        return df.agg(F.avg(hit).alias("accuracy"))
    return df.agg((F.sum(hit * F.col(pairs)) / F.sum(F.when(hit.isNotNull(), F.col(pairs)))).alias("accuracy"))


def confusion_matrix(
    df: DataFrame, label: str = "label", predict: str = "predict", classes: list | None = None, pairs: str | None = None
) -> DataFrame:
    """One row per actual class, one column ``predicted_<class>`` per predicted class.

    Classes are those stated, or 0, 1 and whatever else is predicted, of which there may be ``MOST_CLASSES``.
    """
    if classes is None:
        found = df.select(predict).distinct().where(F.col(predict).isNotNull()).limit(MOST_CLASSES + 1).collect()
        if len(found) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} values are predicted: state the classes")
        classes = sorted({0, 1, *(r[0] for r in found)}, key=lambda v: (isinstance(v, str), v))
    each = F.lit(1) if pairs is None else F.col(pairs)
    hits = [F.sum(F.when(F.col(predict) == F.lit(v), each).otherwise(0)).cast("long").alias(f"predicted_{v}") for v in classes]
    return df.groupBy(F.col(label).alias("actual")).agg(*hits)


def classification_report(df: DataFrame, label: str = "label", predict: str = "predict", pairs: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, their macro and weighted means, and accuracy."""
    cells = df.groupBy(F.col(label).alias("a"), F.col(predict).alias("p")).agg(_number(pairs).alias("n"))
    # every row counts for its actual class and for its predicted class; from here on a few rows
    actual = cells.select(
        F.col("a").alias("class"), "n", F.lit(0).cast("long").alias("called"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")
    )
    called = cells.select(
        F.col("p").alias("class"), F.lit(0).cast("long").alias("n"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")
    )
    sums = actual.unionAll(called).groupBy("class").agg(
        F.sum("n").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(_ratio(F.col("hit"), F.col("called")), zero)
    recall = F.coalesce(_ratio(F.col("hit"), F.col("support")), zero)
    per = sums.select("class", precision.alias("precision"), recall.alias("recall"), "support", "hit")
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.coalesce(_ratio(2 * F.col("precision") * F.col("recall"), both), zero))
    means = per.agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("s"),
        (F.sum("hit") / F.sum("support")).alias("acc"),
    )
    extra = means.selectExpr(
        "stack(3, 'macro avg', m_precision, m_recall, m_f1, s, 'weighted avg', w_precision, w_recall, w_f1, s,"
        " 'accuracy', acc, acc, acc, s) as (class, precision, recall, f1, support)"
    )
    return per.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support").unionByName(extra)
