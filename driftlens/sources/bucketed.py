"""Tables laid out by the hash of a key: joins and groupings on the key need no shuffle.

Spark keeps a table's buckets in its catalog only, which ends with the session. So the
layout is stored beside the files, and reading registers the table again under a name of
its own; the files are external and stay when the name goes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from .files import write_parquet

_LAYOUT = "key string, buckets int, ddl string, partition_by array<string>"


def _name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, partition_by=()) -> None:
    """Write ``df`` over ``buckets`` files (per partition folder) by the hash of ``key``,
    sorted by it; overwrites. The one shuffle that later joins on the key save."""
    spark, name = df.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    w = (df.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", path)
         .bucketBy(buckets, key).sortBy(key))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    layout = spark.createDataFrame([(key, buckets, df.schema.toDDL(), list(partition_by))], _LAYOUT)
    write_parquet(layout.coalesce(1), f"{path}.layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_bucketed`` wrote to ``path``, with its layout."""
    layout, name = spark.read.schema(_LAYOUT).parquet(f"{path}.layout").first(), _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    folders = f"PARTITIONED BY ({', '.join(layout.partition_by)}) " if layout.partition_by else ""
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({layout.ddl}) USING parquet {folders}CLUSTERED BY ({layout.key}) "
              f"SORTED BY ({layout.key}) INTO {layout.buckets} BUCKETS LOCATION '{location}'")
    if layout.partition_by:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
