"""Incremental scoring with Structured Streaming.

New files landing in a folder are scored with a saved model in
micro-batches. Each micro-batch is scored with the same batch operator
(``score_nb``) and written to its own ``epoch=<id>`` folder with
overwrite, so a micro-batch replayed after a failure rewrites the same
output (exactly-once results with an at-least-once sink). The stream's
progress lives in ``checkpoint_dir`` (shared storage on a cluster).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.naive_bayes import NBModel, score_nb


def score_stream(spark: SparkSession, model: NBModel, source_dir: str, schema: str,
                 out_dir: str, checkpoint_dir: str, text: str = "text", id_col: str = "row_id",
                 keep=(), max_files_per_trigger: int | None = None,
                 available_now: bool = True) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        scored = score_nb(model, batch, text=text, id_col=id_col, keep=keep).drop("logits")
        scored.write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id}"))

    w = (stream.writeStream.foreachBatch(score_batch)
               .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def scored_distribution(spark: SparkSession, out_dir: str, label: str = "pred_label",
                        by: str = "dataset") -> DataFrame:
    """Counts of predicted labels per dataset over what has been scored so far. It reads
    the epoch folders themselves, so a rewritten epoch is counted once."""
    return (spark.read.parquet(out_dir).filter(F.col(label).isNotNull())
                 .groupBy(by, label).agg(F.count(F.lit(1)).alias("n")))
