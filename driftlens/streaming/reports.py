"""Reports over a stream of scored rows, kept up to date by keyed state.

Rows may come twice (a replayed file) and out of order. A row is counted once by its key:
the state holds the keys seen within the watermark and one row per report group, and no
earlier row is read again. Rows later than the watermark allows are dropped by Spark, and
a replay of a row that is older than the watermark is dropped with them, so neither
changes the counts. Each trigger writes the whole report (one row per dataset and label),
overwriting the one before it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import write_parquet


def label_report(rows: DataFrame, gold: str = "gold", pred: str = "pred_label", by: str = "dataset") -> DataFrame:
    """Per dataset and predicted label: rows, right ones and the sum of confidences. The
    same for a table and for a stream."""
    right = F.col(gold).eqNullSafe(F.col(pred)).cast("long")
    return rows.groupBy(by, F.col(pred).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_correct"), F.sum("pred_confidence").alias("confidence"))


def distribution(report: DataFrame, by: str = "dataset") -> DataFrame:
    """Shares of the labels, accuracy and mean confidence from a report of ``label_report``."""
    total = report.groupBy(by).agg(F.sum("n").alias("_all"))
    return report.join(F.broadcast(total), by).select(
        by, "label", "n", (F.col("n") / F.col("_all")).alias("p"), (F.col("n_correct") / F.col("n")).alias("accuracy"),
        (F.col("confidence") / F.col("n")).alias("mean_confidence"))


def report_stream(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint_dir: str,
                  key: str = "row_id", time: str = "ts", lateness: str = "1 day", max_files_per_trigger: int | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Keep ``label_report`` of the scored files landing in ``source_dir`` under
    ``out_dir/report`` up to date. ``time`` is the event time that ``lateness`` is counted in."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    once = (reader.parquet(source_dir).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key]))

    def write(report: DataFrame, epoch: int) -> None:
        # a replayed epoch writes the same report again
        write_parquet(report.withColumn("epoch", F.lit(epoch)).coalesce(1), os.path.join(out_dir, "report"))

    w = (label_report(once).writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
