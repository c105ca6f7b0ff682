"""Counts taken while a job writes its rows, instead of by further passes.

The metrics are aggregates of the write's own plan (``DataFrame.observe``): they are
exact when the write is done, and cost no scan. Rows are counted for each dataset of a
given list; a row of another dataset fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..checks import one_of, require_columns
from ..sources.files import write_parquet

REPORT = ("dataset string, n_rows long, n_null_text long, n_blank_text long, n_null_label long, n_chars long")


def _count(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("long")


def observe_load(df: DataFrame, datasets, text: str = "text", label: str = "gold", by: str = "dataset"):
    """(``df`` to be written, its Observation): rows, null and blank texts, null labels and
    characters of each dataset."""
    require_columns(df, [text, label, by], "observe_load")
    seen = Observation()
    d, t, y = one_of(by, datasets), F.col(text), F.col(label)
    exprs = []
    for i, name in enumerate(datasets):
        own = d == F.lit(name)
        exprs += [_count(own).alias(f"n_rows_{i}"), _count(own & t.isNull()).alias(f"n_null_text_{i}"),
                  _count(own & (F.btrim(t) == "")).alias(f"n_blank_text_{i}"),
                  _count(own & y.isNull()).alias(f"n_null_label_{i}"),
                  F.coalesce(F.sum(F.when(own, F.length(t).cast("long"))), F.lit(0)).alias(f"n_chars_{i}")]
    return df.observe(seen, *exprs), seen


def load_rows(seen: Observation, datasets) -> list[tuple]:
    """Rows of ``REPORT`` once the observed job has run."""
    got = seen.get
    names = ("n_rows", "n_null_text", "n_blank_text", "n_null_label", "n_chars")
    return [(d, *[got[f"{n}_{i}"] for n in names]) for i, d in enumerate(datasets)]


def write_observed(df: DataFrame, path: str, datasets, partition_by=None, write=write_parquet, **names) -> DataFrame:
    """Write ``df`` (as Parquet, or by ``write(rows, path, partition_by=...)``) and return its
    load report, one row per dataset."""
    rows, seen = observe_load(df, datasets, **names)
    write(rows, path, partition_by=partition_by)
    return df.sparkSession.createDataFrame(load_rows(seen, datasets), REPORT)


def write_counted(df: DataFrame, path: str, partition_by=None, write=write_parquet, **conditions: Column) -> dict:
    """Write ``df`` and return how many of its rows meet each condition."""
    seen = Observation()
    write(df.observe(seen, *[_count(c).alias(n) for n, c in conditions.items()]), path, partition_by=partition_by)
    return dict(seen.get)


ALIGNMENT = ("n_gold long, n_pred long, n_aligned long, n_gold_only long, n_pred_only long, "
             "n_gold_again long, n_pred_again long, n_correct long")


def write_aligned(gold: DataFrame, pred: DataFrame, path: str, key: str = "row_id", gold_col: str = "gold",
                  pred_col: str = "pred_label") -> DataFrame:
    """Write the rows whose key is on both sides, with the key, ``gold_col`` and
    ``pred_col``, and return one row that says how well the sides fit: rows of each side,
    aligned keys, keys of one side only, rows beyond the first of a key, correct rows.

    One shuffle and no failure, unlike ``metrics.gold_pred_join``: for files whose fit is
    not known. Of several rows of a key the least value counts. Null keys align with nothing."""
    both = (gold.select(F.col(key).alias(key), F.lit(1).alias("_g"), F.lit(0).alias("_p"), F.col(gold_col).alias(gold_col),
                        F.lit(None).alias(pred_col))
            .unionByName(pred.select(F.col(key).alias(key), F.lit(0).alias("_g"), F.lit(1).alias("_p"),
                                     F.lit(None).alias(gold_col), F.col(pred_col).alias(pred_col))))
    groups = both.groupBy(key).agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"), F.min(gold_col).alias(gold_col),
                                   F.min(pred_col).alias(pred_col))
    g, p, known = F.col("_g"), F.col("_p"), F.col(key).isNotNull()
    on_both = known & (g > 0) & (p > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    seen = Observation()
    out = groups.observe(
        seen, total(g).alias("n_gold"), total(p).alias("n_pred"), _count(on_both).alias("n_aligned"),
        _count((g > 0) & ~on_both).alias("n_gold_only"), _count((p > 0) & ~on_both).alias("n_pred_only"),
        total(F.greatest(g - 1, F.lit(0))).alias("n_gold_again"), total(F.greatest(p - 1, F.lit(0))).alias("n_pred_again"),
        _count(on_both & F.col(gold_col).eqNullSafe(F.col(pred_col))).alias("n_correct"))
    write_parquet(out.filter(on_both).select(key, gold_col, pred_col), path)
    got = seen.get
    return gold.sparkSession.createDataFrame([tuple(got[f.split()[0]] for f in ALIGNMENT.split(", "))], ALIGNMENT)
