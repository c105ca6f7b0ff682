"""Dense label index: class id <-> original label, so a label space with
gaps still maps to 0..C-1 and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_index(df: DataFrame, label: str = "gold") -> DataFrame:
    """One row per distinct label: ``label``, ``label_idx`` (by label
    ascending, from 0) and its row count ``n``. The window runs on the
    label-level table only."""
    counts = (df.filter(F.col(label).isNotNull())
                .groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    w = Window.orderBy("label")
    return counts.withColumn("label_idx", (F.dense_rank().over(w) - 1).cast("int"))
