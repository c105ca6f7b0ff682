"""Landed API pages: envelope unwrap and in-order page assembly.

A paged source lands one JSON document per request, ``{"rows": [{"row": {...}}]}``.
Assembly keeps pages in offset order and stops after the first page that is short, or
at the first page that is missing or empty. A page without rows is an empty page; a page
that is not JSON, or a file without a page number, fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_landed_pages(spark: SparkSession, path: str, row_ddl: str) -> DataFrame:
    """One landed file per page; returns ``page``, ``pos``, ``row.*``.

    The page number is the integer in the file name (``page-00003.json``); a file
    without one raises. A file without ``rows`` or with an empty list contributes no
    rows."""
    raw = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    number = F.regexp_extract("_file", r"([0-9]+)\.json$", 1).try_cast("long")
    page = F.coalesce(number, F.raise_error(F.concat(F.lit("no page number in the name of "), "_file")))
    return unwrap_envelope(raw.withColumn("page", page), "value", row_ddl, keep=("page",))


def unwrap_envelope(df: DataFrame, json_col: str, row_ddl: str, keep=()) -> DataFrame:
    """``rows[].row`` of each envelope as records with their 0-based position; an
    envelope that does not parse fails the job."""
    env = F.from_json(F.col(json_col), f"rows array<struct<row: struct<{row_ddl}>>>", {"mode": "FAILFAST"})
    rows = env.getField("rows")
    return (df.select(*keep, F.posexplode(rows).alias("pos", "_r"))
              .select(*keep, F.col("pos").cast("long").alias("pos"), "_r.row.*"))


def assemble_pages(rows: DataFrame, page_size: int, limit: int | None = None,
                   offset: int = 0, page_col: str = "page", pos_col: str = "pos",
                   feed_cols=()) -> DataFrame:
    """Keep the rows a sequential pager would have fetched from each feed
    (``feed_cols``; none: one feed), from row ``offset`` on.

    Pages are read in order, from the one that holds ``offset``, until a page holds
    fewer than ``page_size`` rows (kept, then stop) or a page is missing or empty
    (stop). At most ``limit`` rows of a feed are kept, in order. ``row_index`` is the
    row's place in its source.

    No ordered window over pages: one aggregate counts the rows of each page, a second
    one tells for each page whether the next one exists, and a third one has each
    feed's first short page and first gap."""
    feeds = list(feed_cols)
    start = offset // page_size
    sizes = (rows.filter(F.col(page_col) >= start)
                 .groupBy(*feeds, F.col(page_col).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    # A page says its own size, and to the page before that it has a successor.
    says = F.explode(F.array(F.struct(F.col("_p").alias("p"), F.col("_n").alias("own"), F.lit(None).cast("long").alias("next")),
                             F.struct((F.col("_p") - 1).alias("p"), F.lit(None).cast("long").alias("own"), F.col("_n").alias("next"))))
    both = sizes.select(*feeds, says.alias("s")).groupBy(*feeds, F.col("s.p").alias("p")).agg(
        F.max("s.own").alias("own"), F.max("s.next").alias("next"))
    last = both.filter("own is not null").groupBy(*feeds).agg(
        F.min(F.when(F.col("own") < page_size, F.col("p"))).alias("_short"),
        F.min(F.when(F.col("next").isNull(), F.col("p"))).alias("_end"),
        F.max((F.col("p") == start).cast("int")).alias("_begun"))
    last = last.filter("_begun = 1").select(*feeds, F.least(F.coalesce("_short", "_end"), "_end").alias("_last"))
    if feeds:
        kept = rows.join(last, feeds)
    else:  # one row, or none
        kept = rows.withColumn("_one", F.lit(1)).join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one").drop("_one")
    idx = (F.col(page_col) * F.lit(page_size) + F.col(pos_col)).cast("long")
    kept = (kept.filter((F.col(page_col) >= start) & (F.col(page_col) <= F.col("_last")))
                .withColumn("row_index", idx).filter(F.col("row_index") >= offset))
    if limit is not None:
        kept = kept.filter(F.col("row_index") < offset + limit)
    return kept.select(*rows.columns, "row_index")
