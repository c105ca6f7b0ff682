"""Row positions of written files: the place of every row in the files' order.

Files are ordered by name (numbers in names by value) and rows by their place in the
file, as a reader of one file after the other sees them. One pass counts the rows of each
file or file split; only these counts are added up on the driver, which lists the files
anyway. The rows themselves are never ordered or moved: a row's position is the base of
its split plus its place in it."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_scratch
from .files import read_csv

MAX_SPLITS = 1_000_000   # counts that reach the driver: a path and two numbers each
SPLIT = "file string, at long, first long, n long"


class Numbered(NamedTuple):
    rows: DataFrame   # the columns read, and the position (long, from 0, dense)
    n: int            # number of rows


def name_order(path: str) -> list:
    """Sort key of a path: text as it is, numbers by value."""
    return [(int(p), "") if p.isdigit() else (-1, p) for p in re.split(r"([0-9]+)", path)]


def _bases(splits: DataFrame) -> tuple[DataFrame, int]:
    """(file, at, base) from the counts of all splits, and the total. ``first`` is what
    the place of a split's first row is counted from."""
    found = splits.limit(MAX_SPLITS + 1).collect()
    if len(found) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} file splits")
    out, total = [], 0
    for r in sorted(found, key=lambda r: (name_order(r.file), r.at)):
        out.append((r.file, r.at, total - r.first))
        total += r.n
    return splits.sparkSession.createDataFrame(out, "_file string, _at long, _base long"), total


def number_parquet(spark: SparkSession, path: str, columns, name: str = "position") -> Numbered:
    """Columns of Parquet files with the rows' positions. Parquet tells a row's place in
    its file, so counting reads no column and numbering is one more scan."""
    scan = spark.read.parquet(path)
    splits = scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first"), F.count(F.lit(1)).alias("n"))
    bases, total = _bases(splits.select("file", "at", "first", "n"))
    rows = scan.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.join(F.broadcast(bases), "_file").withColumn(name, F.col("_base") + F.col("_row"))
    return Numbered(rows.select(*columns, name), total)


def number_csv(spark: SparkSession, path: str, schema: str, required=(), name: str = "position") -> Numbered:
    """Rows of CSV files (see ``files.read_csv``) with their positions. A CSV row does not
    know its place, so rows are written once with a number that ascends within a split;
    the least number of a split is its first row's."""
    rows = read_csv(spark, path, schema, required)
    columns = rows.columns
    held = write_scratch(rows.select(*columns, F.col("_metadata.file_path").alias("_file"),
                                     F.col("_metadata.file_block_start").alias("_at"),
                                     F.monotonically_increasing_id().alias("_row")))
    splits = held.groupBy(F.col("_file").alias("file"), F.col("_at").alias("at")).agg(
        F.min("_row").alias("first"), F.count(F.lit(1)).alias("n"))
    bases, total = _bases(splits)
    rows = held.join(F.broadcast(bases), ["_file", "_at"]).withColumn(name, F.col("_base") + F.col("_row"))
    return Numbered(rows.select(*columns, name), total)


def write_in_order(df: DataFrame, path: str, by, files: int, fmt: str = "parquet") -> None:
    """Write ``df`` sorted by ``by`` over about ``files`` files whose names are in order."""
    keys = [by] if isinstance(by, str) else list(by)
    ordered = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    if fmt == "csv":
        from .files import write_csv

        write_csv(ordered, path)
    else:
        ordered.write.mode("overwrite").parquet(path)
