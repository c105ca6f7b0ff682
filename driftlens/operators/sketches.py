"""Stored statistics that merge: one small row per dataset and day instead of its rows.

Each row holds exact counts, a sketch of the distinct labels (HyperLogLog, 2^12 registers:
three standard errors are ``DISTINCT_ERROR``) and one of the values (KLL, k = 200: a
quantile's rank is right within ``RANK_ERROR``). Days, weeks or all data are answered by
merging rows; the scored rows are read once, when their day is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import require_columns

REGISTERS, KLL_K = 12, 200
DISTINCT_ERROR = 3 * 1.04 / (1 << REGISTERS) ** 0.5
RANK_ERROR = 0.03


def daily_sketches(rows: DataFrame, label: str, value: str, day: str = "day", by: str = "dataset") -> DataFrame:
    """One row per dataset and day: n, n_labels (rows with a label), least, most, labels and
    values (sketches). Null labels and values are in no sketch; a day without any has
    an empty one."""
    require_columns(rows, [label, value, day, by], "daily_sketches")
    # a sketch of nothing is null: the label's hash and the value are sketched as they are
    return rows.groupBy(by, day).agg(
        F.count(F.lit(1)).alias("n"), F.count(label).alias("n_labels"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.hll_sketch_agg(F.col(label).cast("string"), REGISTERS).alias("labels"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("values"))


def merge_sketches(stored: DataFrame, by=("dataset",)) -> DataFrame:
    """Rows of ``daily_sketches`` merged to one per group of ``by`` (any columns of theirs)."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_labels").alias("n_labels"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("labels").alias("labels"), F.kll_merge_agg_double("values", F.lit(KLL_K)).alias("values"))


def read_sketches(merged: DataFrame, quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """What merged rows say: the counts, distinct labels and the quantiles of the values
    (null without values)."""
    names = [c for c in merged.columns if c not in ("labels", "values")]
    some = F.col("least").isNotNull()
    at = [F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select(*names, F.hll_sketch_estimate("labels").alias("n_distinct"), *at)
