"""Documents to training pieces: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Rows with a null doc_id pass the filters untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.checks import broadcast_if_bounded
from driftlens.llm import line_templates, pieces, positional_index, superminhash, toxicity
from driftlens.llm.queries import held_out
from driftlens.llm.scratch import materialise
from driftlens.session import scratch_path, scratch_scope
from driftlens.sources.tables import read_table

#: Ids are broadcast up to this many (8 bytes each), and sorted and merged beyond.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_bounded(materialise(ids), BROADCAST_IDS), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples vote toxic go."""
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    model = toxicity.fit(docs, labels.where(~held_out()))
    columns = docs.columns
    return toxicity.score(docs, model).where("predicted = 0").select(*columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    columns = docs.columns
    left = line_templates.drop_recurring_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    groups = superminhash.near_duplicates(docs.select("doc_id", "text"))
    return _without(docs, groups.where("not kept").select("doc_id")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hits = positional_index.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.where("n_hit > 0").select("doc_id")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

#: Nearest-neighbour votes and merge-model paths have no SQL form; tests/llm holds the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave. What a stage made on its way is removed once
    its result is written; the results themselves stay, as the folder's owner decides."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch_scope(spark):
            left = stage(spark, docs, sf_dir)
            left.write.parquet(path)
        docs = spark.read.schema(left.schema).parquet(path)
    return docs
