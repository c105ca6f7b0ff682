"""Multi-dataset job: many inputs, one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_datasets(named: dict[str, DataFrame], col: str = "dataset") -> DataFrame:
    """Tag each input with its dataset name and stack them by column name;
    columns one input lacks are NULL for its rows."""
    tagged = [df.withColumn(col, F.lit(name)) for name, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
