"""First-label parse contract: golden table, Spark expression == contract."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from driftlens.functions.labels import first_label, parse_outcome
from driftlens.operators.clean import label_parse_report, prepare_label
from driftlens.checks import ColumnContractError

GOLDEN = [
    ("[27]", 27), ("[3, 5]", 3), ("[ 7 ,8]", 7), ("[7,]", 7), ("[]", 0), ("", 0), ("   ", 0),
    (None, 0), ("5", 5), ("+5", 5), ("-1", -1), ("[-1]", -1), ("[3 5]", 0), ("[1,2", 0),
    ("[2,a]", 0), ("[007]", 0), ("(3,4)", 0), ("3,4", 0), ("--5", 0), ("5.7", 5),
    ("[5.9]", 5), ("1e1", 10), ("[1.5e1]", 15), ("nan", 0), ("1e400", 0), ("None", 0),
    ("[None]", 0), ("[[3]]", 0), ("{1}", 0), ("5L", 0), ("007", 7), ("1_000", 1000),
    ("[1_000]", 1000), ("'5'", 5), ("['5']", 5), ("True", 1), ("[True]", 1), ("0x1F", 31),
    ("5 # x", 5), ("[5] # c", 5), ("\t[27]\n", 27), ("  12 　", 12),
    ("99999999999", 0), ("[99999999999]", 0), ("-0", 0),
]


def test_spark_expression_matches_contract(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, labels string")
    got = {r.i: r.label for r in df.select("i", first_label("labels", StringType()).alias("label")).collect()}
    for i, (t, expected) in enumerate(GOLDEN):
        assert got[i] == expected, (t, got[i], expected)


def test_native_array_and_int_columns(spark):
    schema = StructType([StructField("labels", ArrayType(IntegerType())), StructField("x", IntegerType())])
    df = spark.createDataFrame([([27, 3], 4), ([], None), (None, 2), ([None, 5], 1)], schema)
    out = df.select(first_label("labels", ArrayType(IntegerType())).alias("a"),
                    first_label("x", IntegerType()).alias("b")).collect()
    assert [r.a for r in out] == [27, 0, 0, 0]
    assert [r.b for r in out] == [4, 0, 2, 1]


def test_default_label_option(spark):
    df = spark.createDataFrame([("[]",), ("x",), ("[4]",)], "labels string")
    out = [r.l for r in df.select(first_label("labels", StringType(), default=-1).alias("l")).collect()]
    assert out == [-1, -1, 4]
    out = [r.l for r in df.select(first_label("labels", StringType(), default=None).alias("l")).collect()]
    assert out == [None, None, 4]


def test_bad_native_element_gives_default(spark):
    df = spark.createDataFrame([(["a"],), (["7"],), (["99999999999"],)], "labels array<string>")
    got = [r.l for r in df.select(first_label("labels", df.schema["labels"].dataType).alias("l")).collect()]
    assert got == [0, 7, 0]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("[]",), ("x",)], "labels string")
    plan = df.select(first_label("labels", StringType()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_parse_report_counts(spark):
    df = spark.createDataFrame([("[1]",), ("2",), ("",), (None,), ("[]",), ("5.5",), ("[0]",), ("x",)],
                               "labels string")
    rep = {r.outcome: (r.n, r.n_default) for r in label_parse_report(df).collect()}
    assert rep == {"list": (2, 0), "scalar": (2, 0), "blank": (1, 1), "missing": (1, 1),
                   "empty_list": (1, 1), "fallback": (1, 1)}
    assert sorted(r[0] for r in df.select(parse_outcome("labels")).distinct().collect()) == sorted(rep)


def test_label_precedence(spark):
    both = spark.createDataFrame([("3", "[5]")], "label string, labels string")
    assert prepare_label(both).first().label == 3
    only = spark.createDataFrame([("[5]",)], "labels string")
    assert prepare_label(only).first().label == 5
    with pytest.raises(ColumnContractError, match="available columns"):
        prepare_label(spark.createDataFrame([("x",)], "text string"))
