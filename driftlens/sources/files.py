"""CSV edge (export/import with a column contract) and parquet sinks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..checks import require_columns
from ..constants import NA_TOKENS
from ..functions.text import na_to_null


def write_parquet(df: DataFrame, path: str, partition_by=None) -> None:
    """Canonical sink: idempotent overwrite (a retried job rewrites the same
    output), optionally partitioned for partition pruning downstream."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _stringify(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays or structs: render them as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, StructType, MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export: header, quoted with doubled quotes, overwrite. Cell text
    is written as is: Spark's writer trims surrounding whitespace unless
    told not to, which would turn ``" "`` into an empty (then missing) cell."""
    (_stringify(df).write.mode("overwrite")
        .option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))


_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _csv_schema(spark: SparkSession, path: str, schema: str, required):
    """(columns wanted, header, types of the header's columns) after the contract's check."""
    wanted = StructType.fromDDL(schema)
    header = spark.read.options(**_CSV).csv(path).columns
    require_columns(spark.createDataFrame([], StructType([StructField(c, StringType()) for c in header])),
                    required, where=path)
    kinds = {f.name: f.dataType for f in wanted.fields}
    return wanted, header, StructType([StructField(c, kinds.get(c, StringType())) for c in header])


def read_csv(spark: SparkSession, path: str, schema: str, required=(),
             na_tokens=NA_TOKENS) -> DataFrame:
    """CSV scan by the names in the header: the columns of ``schema`` in its order,
    whatever their order in the files; columns that ``schema`` lacks are not returned.

    A column of ``required`` that the header lacks raises, another one is NULL. Every
    file must have the same header. A cell that does not fit its type, or a row of
    another length, fails the job. Multi-line quoted fields; exact NA tokens of string
    columns become NULL."""
    wanted, header, found = _csv_schema(spark, path, schema, required)
    # columnNameOfCorruptRecord is not read: a bad row must fail, not be kept
    df = spark.read.schema(found).options(**_CSV, mode="FAILFAST", enforceSchema=False).csv(path)
    df = df.select(*[F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
                     for f in wanted.fields])
    strings = [f.name for f in wanted.fields if isinstance(f.dataType, StringType)]
    if na_tokens and strings:
        df = df.withColumns({c: na_to_null(c, na_tokens) for c in strings})
    return df


RECORD = "corrupt_record"


class Quarantine(NamedTuple):
    rows: DataFrame      # the columns of the schema
    rejects: DataFrame   # the same columns where they could be read, corrupt_record, reason
    counts: dict         # read, kept, rejected and every reason


def quarantine_csv(spark: SparkSession, path: str, schema: str, out: str, required=(),
                   na_tokens=NA_TOKENS) -> Quarantine:
    """``read_csv`` for files that may hold bad rows: they are set apart instead of failing
    the job. Rows go to ``out/rejected=false``, rejects to ``out/rejected=true``, both
    written by one pass that also counts them.

    A row is rejected for the first of these reasons: ``damaged`` (another number of cells,
    or one that does not fit its type; the record is kept as text), or ``missing <column>``
    for a column of ``required`` that is empty or an NA token. A file with another
    header still fails the job, as does a column of ``schema`` named like the added ones."""
    wanted, header, found = _csv_schema(spark, path, schema, required)
    clash = {RECORD, "reason", "rejected"} & {f.name for f in [*wanted.fields, *found.fields]}
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    found = found.add(RECORD, StringType())
    df = spark.read.schema(found).options(**_CSV, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD,
                                          enforceSchema=False).csv(path)
    df = df.select(*[F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
                     for f in wanted.fields], RECORD)
    strings = [f.name for f in wanted.fields if isinstance(f.dataType, StringType)]
    if na_tokens and strings:
        df = df.withColumns({c: na_to_null(c, na_tokens) for c in strings})
    reason = F.when(F.col(RECORD).isNotNull(), F.lit("damaged"))
    names = ["damaged"]
    for c in required:
        reason = reason.when(F.col(c).isNull(), F.lit(f"missing {c}"))
        names.append(f"missing {c}")
    df = df.withColumn("reason", reason).withColumn("rejected", F.col("reason").isNotNull())
    seen = Observation()
    counted = [F.count_if(F.col("reason") == n).alias(f"n_{i}") for i, n in enumerate(names)]
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if("rejected").alias("rejected"), *counted),
                  out, partition_by=["rejected"])
    got = seen.get
    counts = {"read": got["read"], "kept": got["read"] - got["rejected"], "rejected": got["rejected"]}
    counts |= {n: got[f"n_{i}"] for i, n in enumerate(names)}
    back = spark.read.schema(df.schema).parquet(out)
    return Quarantine(back.filter("not rejected").select(*[f.name for f in wanted.fields]),
                      back.filter("rejected").drop("rejected"), counts)
