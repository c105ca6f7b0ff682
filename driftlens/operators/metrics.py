"""Evaluation metrics: correctness, accuracy, per-label stats, macro-F1,
value counts, top-k labels and the row-aligned gold/prediction join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correct_flag(df: DataFrame, gold: str = "gold", pred: str = "pred_label",
                 out: str = "correct") -> DataFrame:
    """1 when gold equals pred, else 0. Null-safe: a NULL on either side is
    wrong rather than dropped from later averages."""
    return df.withColumn(out, F.col(gold).eqNullSafe(F.col(pred)).cast("int"))


def group_keys(by) -> list:
    """Grouping columns of a ``by`` argument: None, one name, or a list."""
    return [by] if isinstance(by, str) else list(by or [])


def overall_accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred_label",
                     by=None) -> DataFrame:
    """Accuracy over all rows, or per group of ``by`` (one partially
    aggregated groupBy; a dominant group costs one partial row per task)."""
    c = F.col(gold).eqNullSafe(F.col(pred)).cast("int")
    return df.groupBy(*group_keys(by)).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n_correct"),
        F.avg(c).alias("accuracy"))


def label_stats(df: DataFrame, gold: str = "gold", pred: str = "pred_label",
                label_name: str = "label_id", by=None, sort: bool = True) -> DataFrame:
    """Support and accuracy per gold label (per group of ``by``), largest
    support first (ties by label id). Partial aggregation keeps a dominant
    label cheap. ``sort=False`` where the table feeds another operator."""
    keys = group_keys(by)
    c = F.col(gold).eqNullSafe(F.col(pred)).cast("int")
    out = (df.groupBy(*keys, F.col(gold).alias(label_name))
             .agg(F.count(F.lit(1)).alias("support"), F.avg(c).alias("accuracy")))
    return out.orderBy(*keys, F.desc("support"), F.asc(label_name)) if sort else out


def top_n(stats: DataFrame, n: int, by: str = "support", label_name: str = "label_id",
          group=None) -> DataFrame:
    """First ``n`` rows by ``by`` desc, label asc (a TakeOrderedAndProject);
    with ``group``, the first ``n`` of each group. ``stats`` is a label-level
    table, so the per-group window ranks at most (groups x labels) rows."""
    keys = group_keys(group)
    if not keys:
        return stats.orderBy(F.desc(by), F.asc(label_name)).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(label_name))
    return stats.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def value_counts(df: DataFrame, col: str, by=None, name: str = "label") -> DataFrame:
    keys = group_keys(by)
    return (df.filter(F.col(col).isNotNull())
              .groupBy(*keys, F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("n")))


def num_labels(df: DataFrame, col: str = "gold", by=None) -> DataFrame:
    return df.groupBy(*group_keys(by)).agg(F.countDistinct(col).alias("num_labels"))


def rank_top(counts: DataFrame, k: int, by=None, name: str = "label") -> DataFrame:
    """Keep the ``k`` largest ``n`` of each group (ties by label) with their
    0-based rank. ``counts`` is a label-level table: the window ranks at
    most (groups x labels) rows, never row-level data. A NULL label ranks
    after every other and is dropped after ranking, so the filter stays
    above the window and does not change the plan below it."""
    keys = group_keys(by)
    order = [F.col(name).isNull(), F.desc("n"), F.asc(name)]
    if not keys:
        top = counts.orderBy(*order).limit(k)
        # ``top`` holds at most k rows, so this unpartitioned window is tiny.
        w = Window.orderBy(*order)
        return (top.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
                   .filter(F.col(name).isNotNull()))
    w = Window.partitionBy(*keys).orderBy(*order)
    return (counts.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
                  .filter((F.col("rank") < k) & F.col(name).isNotNull()))


def topk_labels(df: DataFrame, k: int, col: str = "gold", name: str = "label",
                by=None) -> DataFrame:
    """The ``k`` most frequent labels (per group of ``by``) with their
    0-based rank (ties by label)."""
    return rank_top(value_counts(df, col, by=by, name=name), k, by=by, name=name)


def per_label_counts(df: DataFrame, gold: str = "gold", pred: str = "pred_label",
                     by=None) -> DataFrame:
    """Per label (per group of ``by``): gold support, true positives and
    predicted count.

    One shuffle: each row contributes a gold-side and a pred-side record,
    summed per label with map-side partial aggregation (so a dominant label
    costs one partial row per task, not one task of its own)."""
    keys = group_keys(by)
    g, p = F.col(gold), F.col(pred)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tp = g.eqNullSafe(p).cast("long")
    sides = F.array(
        F.struct(g.alias("label"), one.alias("s"), tp.alias("tp"), zero.alias("q")),
        F.struct(p.alias("label"), zero.alias("s"), zero.alias("tp"), one.alias("q")),
    )
    return (df.select(*keys, F.inline(sides)).filter(F.col("label").isNotNull())
              .groupBy(*keys, "label").agg(F.sum("s").alias("support"), F.sum("tp").alias("tp"),
                                           F.sum("q").alias("predicted")))


def macro_f1(df: DataFrame, gold: str = "gold", pred: str = "pred_label", by=None) -> DataFrame:
    """Unweighted mean F1 over the union of gold and predicted labels (per
    group of ``by``); a label with no true positive scores 0."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"),
                                 (F.col("support") + F.col("predicted")).cast("double")),
                    F.lit(0.0))
    return per_label_counts(df, gold, pred, by).groupBy(*group_keys(by)).agg(
        F.avg(f1).alias("f1_macro"), F.count(F.lit(1)).cast("long").alias("n_labels"))


def gold_pred_join(gold: DataFrame, pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Row-aligned join of gold rows and prediction rows on an explicit key.

    Alignment is 1:1 by contract, so the join is done as one aggregation:
    both sides are stacked and grouped by the key (a single shuffle), each
    group taking its side's values. The same pass checks the contract: a
    key seen on one side only, or twice on a side, raises at execution
    instead of silently dropping or duplicating rows."""
    gcols = [c for c in gold.columns if c != key]
    pcols = [c for c in pred.columns if c != key]
    clash = set(gcols) & set(pcols)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    g = gold.withColumn("_g", F.lit(1))
    p = pred.withColumn("_p", F.lit(1))
    both = g.unionByName(p, allowMissingColumns=True)
    agg = both.groupBy(key).agg(
        F.sum("_g").alias("_ng"), F.sum("_p").alias("_np"),
        *[F.first(c, ignorenulls=True).alias(c) for c in gcols + pcols])
    ok = (F.when(F.coalesce("_ng", F.lit(0)) * F.coalesce("_np", F.lit(0)) == 0,
                 F.raise_error(F.lit("gold and prediction rows are not aligned on the key")))
           .when((F.col("_ng") > 1) | (F.col("_np") > 1),
                 F.raise_error(F.lit("duplicate key in gold or prediction rows")))
           .otherwise(F.lit(True)))
    return agg.filter(ok).select(key, *gcols, *pcols)


def gold_pred_positional(gold, pred, position: str = "position") -> DataFrame:
    """Rows of two numbered files side by side, the first with the first (``gold`` and
    ``pred``: ``sources.positions.Numbered``). Unequal numbers of rows raise at once,
    from the counts of the files; the join itself is ``gold_pred_join`` on the position."""
    if gold.n != pred.n:
        raise ValueError(f"{gold.n} gold rows, but {pred.n} prediction rows: they cannot be aligned by position")
    return gold_pred_join(gold.rows, pred.rows, position)


def evaluate(pred: DataFrame, gold: str = "gold", label: str = "pred_label") -> DataFrame:
    """Accuracy and macro-F1 of one prediction set, from one per-label table."""
    per = per_label_counts(pred, gold, label)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"),
                                 (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return per.agg(F.sum("support").cast("long").alias("n"),
                   (F.sum("tp") / F.sum("support")).cast("double").alias("accuracy"),
                   F.avg(f1).alias("f1_macro"))
