"""Domain-shift reports: label distributions per dataset, grouped shares,
dense label vectors and their correlation, top-k confusion, confidence
histograms. Row-level work is always a partially-aggregated groupBy; what
follows runs on label-level tables whose size is bounded by the label
domain or by ``k``. Reports over a list of datasets take that list from the caller
and fail on a row of any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checks import one_of
from ..constants import HIST_BINS


def label_distribution(df: DataFrame, label: str = "pred_label", by: str = "dataset",
                       sort: bool = True) -> DataFrame:
    """Share of each label within each dataset (nulls excluded), by label.

    ``sort=False`` when the distribution feeds another aggregate: the
    optimiser keeps a sort under a floating-point ``sum`` (its result
    depends on the order of addition), so the sort and its range exchange
    would run for nothing."""
    counts = (df.filter(F.col(label).isNotNull())
                .groupBy(F.col(by).alias("dataset"), F.col(label).alias("label"))
                .agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("dataset"))
    out = counts.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), total),
                                            F.lit(0.0)))
    return out.orderBy("dataset", "label") if sort else out


def wide_distribution(dist: DataFrame, datasets, value: str = "p") -> DataFrame:
    """One row per label, one column per dataset, 0 where a dataset lacks the
    label: the three-way full outer join on label, done as one pivot."""
    # One value per (label, dataset) cell, so ``max`` equals ``first``; unlike
    # ``first`` it is order-insensitive, which lets the optimiser drop the
    # label sort of ``dist`` (and its range exchange) below this aggregate.
    w = dist.withColumn("dataset", one_of("dataset", datasets)).groupBy("label").pivot("dataset", list(datasets)).agg(F.max(value))
    return w.fillna(0.0, subset=list(datasets)).orderBy("label")


def label_groups(dist: DataFrame, datasets, keep=(27, 0)) -> DataFrame:
    """Collapse labels into each of ``keep`` plus ``others``; summed shares per
    dataset. Every group is reported even when empty, in the order given."""
    names = [str(k) for k in keep] + ["others"]
    grp = F.lit("others")
    for k in reversed(keep):
        grp = F.when(F.col("label") == F.lit(k), F.lit(str(k))).otherwise(grp)
    sums = (dist.withColumn("label_group", grp).withColumn("dataset", one_of("dataset", datasets))
                .groupBy("label_group").pivot("dataset", list(datasets)).agg(F.sum("p")))
    spark = dist.sparkSession
    groups = spark.createDataFrame([(n, i) for i, n in enumerate(names)],
                                   "label_group string, group_order int")
    out = F.broadcast(groups).join(sums, "label_group", "left")
    return out.fillna(0.0, subset=list(datasets)).orderBy("group_order").drop("group_order")


def _grid(spark, datasets, n_labels: int) -> DataFrame:
    """Every (dataset, label) pair of a dense domain, generated directly."""
    names = F.array(*[F.lit(d) for d in datasets])
    return spark.range(len(datasets) * n_labels).select(
        F.element_at(names, (F.col("id") / n_labels).cast("int") + 1).alias("dataset"),
        (F.col("id") % n_labels).cast("int").alias("label"))


def dense_counts(df: DataFrame, n_labels: int, datasets, label: str = "pred_label",
                 by: str = "dataset") -> DataFrame:
    """Counts on the dense domain 0..n_labels-1 for each dataset; missing
    pairs are 0, labels outside the domain are dropped."""
    counts = (df.select(label, one_of(by, datasets).alias("dataset"))
                .filter(F.col(label).between(0, n_labels - 1))
                .groupBy("dataset", F.col(label).cast("int").alias("label"))
                .agg(F.count(F.lit(1)).alias("n")))
    grid = _grid(df.sparkSession, datasets, n_labels)
    return (grid.join(counts, ["dataset", "label"], "left")
                .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))


def dense_distribution(df: DataFrame, n_labels: int, datasets, label: str = "pred_label",
                       by: str = "dataset") -> DataFrame:
    """Dense label vector per dataset normalised by the in-domain total; an
    all-zero vector stays zero."""
    c = dense_counts(df, n_labels, datasets, label, by)
    total = F.sum("n").over(Window.partitionBy("dataset"))
    return c.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), total),
                                        F.lit(0.0)))


def distribution_corr(dense: DataFrame, datasets) -> DataFrame:
    """Pearson correlation between the label vectors of every dataset pair.

    The vectors are pivoted side by side (one row per label) and all pairs
    are aggregates of one pass; no self-join. A constant vector has no
    correlation: its values are nulled first, so the pair reports NULL
    instead of dividing by zero."""
    ds = list(datasets)
    w = Window.partitionBy("dataset")
    varying = F.max("p").over(w) > F.min("p").over(w)
    guarded_long = (dense.withColumn("pv", F.when(varying, F.col("p")))
                    .withColumn("dataset", one_of("dataset", ds)))
    wide = guarded_long.groupBy("label").pivot("dataset", ds).agg(F.max("pv"))
    guarded = wide.select(*[F.col(d).alias(f"_v_{i}") for i, d in enumerate(ds)])
    pairs = [(i, j) for i in range(len(ds)) for j in range(len(ds))]
    aggs = guarded.agg(*[F.corr(f"_v_{i}", f"_v_{j}").alias(f"_c_{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(ds[i]).alias("ds_a"), F.lit(ds[j]).alias("ds_b"),
                              F.col(f"_c_{i}_{j}").alias("corr")) for i, j in pairs])
    return aggs.select(F.inline(rows))


def confusion_topk(df: DataFrame, k: int, gold: str = "gold", pred: str = "pred_label",
                   by=None) -> DataFrame:
    """Dense k x k confusion counts over the k most frequent gold labels
    (per group of ``by``).

    A row counts only when both its gold and its predicted label are in the
    top-k set. One pass over the rows: a partially aggregated count per
    (group, gold, pred) pair, a label-level table. The gold supports, the
    top-k ranking and the filter all run on that table. Each group's top-k
    set becomes a rank-ordered array of at most k labels, and the dense grid
    is generated from it with ``sequence`` (k*k cells per group, the size of
    the report itself) and matched to the pair counts by an equi-join."""
    from .metrics import group_keys, rank_top
    keys = group_keys(by)
    pairs = (df.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
               .agg(F.count(F.lit(1)).alias("n")))
    # NULL gold labels are dropped by ``rank_top`` after ranking; a filter
    # here would be pushed below the pair aggregate into this branch only.
    support = pairs.groupBy(*keys, F.col("gold").alias("label")).agg(F.sum("n").alias("n"))
    top = rank_top(support, k, by=keys)
    sets = top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))),
                    lambda x: x.getField("label")).alias("_t"))
    m = F.size("_t")
    cell = F.explode(F.sequence(F.lit(0), m * m - 1)).alias("_c")
    # An empty input still yields one (empty) set when there is no group key.
    grid = (sets.filter(m > 0).select(*keys, "_t", cell)
                .select(*keys, (F.col("_c") / m).cast("int").alias("gi"),
                        (F.col("_c") % m).cast("int").alias("pj"), "_t")
                .select(*keys, "gi", "pj", F.element_at("_t", F.col("gi") + 1).alias("gold"),
                        F.element_at("_t", F.col("pj") + 1).alias("pred")))
    # Null-safe keys (grid keys are never null): a plain equi-join would
    # infer not-null filters into the pair branch only, which makes it differ
    # from the branch feeding the ranking and defeats exchange reuse (the
    # rows would be scanned and aggregated twice).
    on = [*keys, "gold", "pred"]
    cnt = pairs.select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col("n").alias("_n"))
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return (grid.join(cnt, cond, "left")
                .select(*keys, "gold", "pred", "gi", "pj",
                        F.coalesce("_n", F.lit(0)).cast("long").alias("n")))


def confusion_normalise(conf: DataFrame, by=None) -> DataFrame:
    """Each gold row divided by its sum within the top-k block; a zero row
    stays zero."""
    from .metrics import group_keys
    row_sum = F.sum("n").over(Window.partitionBy(*group_keys(by), "gold"))
    return conf.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), row_sum),
                                           F.lit(0.0)))


def confidence_histogram(df: DataFrame, datasets, value: str = "pred_confidence", by: str = "dataset",
                         bins: int = HIST_BINS, shared_edges: bool = False) -> DataFrame:
    """``bins`` equal-width bins per dataset over that dataset's own range (with
    ``shared_edges``: over the range of all), last bin closed; a single-valued range is
    widened by 0.5 on each side.

    Bin assignment follows the usual equal-bin rule: a scaled index, then a
    one-step correction against the exact edges ``lo + i * step`` so values
    sitting on an edge land in the upper bin. Output is dense: every bin of
    every dataset that has a value, with zero counts."""
    ds = list(datasets)
    vals = df.select(one_of(by, ds).alias("dataset"), F.col(value).cast("double").alias("v")).filter(
        F.col("v").isNotNull())
    # At most len(datasets) rows: safe to broadcast.
    stats = vals.groupBy("dataset").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    if shared_edges:
        every = Window.partitionBy()
        stats = stats.select("dataset", F.min("vmin").over(every).alias("vmin"), F.max("vmax").over(every).alias("vmax"))
    stats = stats.select("dataset",
                         F.when(F.col("vmin") == F.col("vmax"), F.col("vmin") - 0.5)
                          .otherwise(F.col("vmin")).alias("lo"),
                         F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 0.5)
                          .otherwise(F.col("vmax")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))

    def edge(i):
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * step)

    idx0 = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) /
                                                        (F.col("hi") - F.col("lo")))),
                   F.lit(bins - 1)).cast("int")
    binned = vals.join(F.broadcast(stats), "dataset").withColumn("b0", idx0)
    binned = binned.withColumn(
        "b1", F.when(F.col("v") < edge(F.col("b0")), F.col("b0") - 1).otherwise(F.col("b0")))
    binned = binned.withColumn(
        "bin", F.when((F.col("v") >= edge(F.col("b1") + 1)) & (F.col("b1") != bins - 1),
                      F.col("b1") + 1).otherwise(F.col("b1")))
    counts = binned.groupBy("dataset", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = stats.select("dataset", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.select("dataset", "bin", edge(F.col("bin")).alias("bin_lo"),
                       edge(F.col("bin") + 1).alias("bin_hi"))
    return (grid.join(counts, ["dataset", "bin"], "left")
                .select("dataset", "bin", "bin_lo", "bin_hi",
                        F.coalesce("n", F.lit(0)).cast("long").alias("n")))
