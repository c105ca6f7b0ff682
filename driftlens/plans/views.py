"""The two standard views every report runs on.

``scored``: predictions over ``embeddings``. Logits are the first 10
embedding values times 10; the prediction is their argmax and the
confidence the max softmax probability. ``gold`` is the stored label.
Rows are assigned to the three datasets by ``vec_id % 3``.

``texts``: ``documents`` as a labelled text corpus; ``gold`` is the
language, and the source number decides the dataset (0-9 in-domain,
10-14 first out-of-domain set, 15 and up the second).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DATASETS
from ..functions.scores import with_prediction
from ..sources.tables import read_table

N_LOGITS = 10
LOGIT_SCALE = 10.0


def dataset_of_row(row_id) -> F.Column:
    names = F.array(*[F.lit(d) for d in DATASETS])
    return F.element_at(names, (F.pmod(row_id, F.lit(len(DATASETS))) + 1).cast("int"))


def scored_from_embeddings(emb: DataFrame) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, N_LOGITS),
                         lambda x: x.cast("double") * F.lit(LOGIT_SCALE))
    base = emb.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("int").alias("gold"),
        logits.alias("logits"),
        dataset_of_row(F.col("vec_id")).alias("dataset"),
    )
    return with_prediction(base)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return scored_from_embeddings(emb)


def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``scored`` with their whole vectors: row_id, gold, dataset, embedding."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("gold"),
                      dataset_of_row(F.col("vec_id")).alias("dataset"), "embedding")


def dataset_of_source(source) -> F.Column:
    n = F.regexp_extract(source, r"^src([0-9]+)$", 1).try_cast("int")
    return (F.when(n < 10, F.lit(DATASETS[0]))
            .when(n < 15, F.lit(DATASETS[1]))
            .otherwise(F.lit(DATASETS[2])))


def texts_from_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("text"),
        F.col("lang").alias("gold"),
        dataset_of_source(F.col("source")).alias("dataset"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"],
                      spread="doc_id")
    return texts_from_documents(docs)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as predictions over their 20 sources, so that a cut at ten labels
    removes some: ``gold`` is the source's number, ``pred_label`` is a label computed
    from the text's length, ``dataset`` is the language."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    gold = F.regexp_extract("source", r"^src([0-9]+)$", 1).try_cast("int")
    guess = F.when(F.pmod("n_chars", F.lit(3)) == 0, gold).otherwise(F.pmod("n_chars", F.lit(20)).cast("int"))
    return docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("dataset"), gold.alias("gold"),
                       guess.alias("pred_label"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as short records over a wide label space: ``text`` is the event's type
    and properties, ``gold`` its user and three-hour slot of the day."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    return ev.select(F.col("event_id").alias("row_id"), F.concat_ws(" ", "event_type", "props").alias("text"),
                     F.concat_ws("/", F.col("user_id").cast("string"),
                                 F.floor(F.hour("ts") / 3).cast("string")).alias("gold"))
