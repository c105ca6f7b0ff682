"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path

__all__ = ["materialise", "scratch_path"]


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what came
    before, and the result can be read several times with column pruning. An open
    ``session.scratch_scope`` removes the table when it is left."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
