"""Row cleaning and label normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..checks import ColumnContractError
from ..constants import NA_TOKENS
from ..functions import jsonx
from ..functions.labels import first_label, outcome_of, with_parse_steps
from ..functions.text import compose, fill_text, na_to_null


def compose_text(df: DataFrame, first: str, second: str, sep: str = " ",
                 out: str = "text") -> DataFrame:
    """``out = strip((first or "") + sep + (second or ""))``."""
    return df.withColumn(out, compose(first, second, sep))


def drop_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def drop_missing(df: DataFrame, cols=("text", "label")) -> DataFrame:
    return df.dropna(subset=list(cols))


def fill_missing_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, fill_text(col))


def recognise_na(df: DataFrame, cols, tokens=NA_TOKENS) -> DataFrame:
    """Exact NA tokens become NULL in the given string columns."""
    return df.withColumns({c: na_to_null(c, tokens) for c in cols})


def project_json(df: DataFrame, json_col: str, ddl: str, keep=()) -> DataFrame:
    return df.select(*keep, jsonx.project(json_col, ddl).alias("_j")).select(*keep, "_j.*")


def with_first_label(df: DataFrame, src: str = "labels", out: str = "label",
                     default: int | None = 0) -> DataFrame:
    """First label of ``src`` as ``out``; ``default`` where there is none."""
    kind = df.schema[src].dataType
    if not isinstance(kind, StringType):
        return df.withColumn(out, first_label(src, kind, default))
    steps = with_parse_steps(df, src)
    return steps.withColumn(out, F.coalesce("_value", F.lit(default).cast("int"))).drop("_cell", "_atom", "_value")


def prepare_label(df: DataFrame, out: str = "label", default: int = 0) -> DataFrame:
    """Label column precedence: an existing ``label`` column is cast to int;
    otherwise the first label of ``labels`` is taken; otherwise an error."""
    if "label" in df.columns:
        return df.withColumn(out, F.col("label").cast("int"))
    if "labels" in df.columns:
        return with_first_label(df, "labels", out, default)
    raise ColumnContractError(
        f"no label column: expected one of ['label', 'labels']; available columns: {df.columns}")


def label_parse_report(df: DataFrame, src: str = "labels") -> DataFrame:
    """Rows per parse outcome, with how many had no label of their own (missing, blank,
    empty or unparseable cells; a genuine label 0 is not one of them)."""
    steps = with_parse_steps(df.select(F.col(src).cast("string").alias("_raw")), "_raw")
    return (steps.select(outcome_of(F.col("_raw"), F.col("_cell"), F.col("_value")).alias("outcome"), "_value")
                 .groupBy("outcome")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.col("_value").isNull().cast("long")).alias("n_default")))
