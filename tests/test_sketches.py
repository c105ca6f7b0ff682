"""Stored sketches: merged figures against exact ones."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.checks import ColumnContractError
from driftlens.operators import sketches as S


def test_merged_days_are_within_the_stated_errors(spark, tmp_dir):
    rng = random.Random(4)
    rows = [("ab"[i % 5 == 0], f"d{i % 9}", rng.randrange(3000), rng.gauss(0, 1) ** 3) for i in range(40_000)]
    df = spark.createDataFrame(rows, "dataset string, day string, label int, value double").repartition(6)
    S.daily_sketches(df, "label", "value").write.parquet(f"{tmp_dir}/s")
    stored = spark.read.parquet(f"{tmp_dir}/s")
    assert stored.count() == 18
    for by in (["dataset"], ["day"], []):
        got = S.read_sketches(S.merge_sketches(stored, by)).collect()
        for r in got:
            mine = [x for x in rows if all(r[k] == x[["dataset", "day"].index(k)] for k in by)]
            values = sorted(x[3] for x in mine)
            assert (r.n, r.n_labels, r.least, r.most) == (len(mine), len(mine), values[0], values[-1])
            users = len({x[2] for x in mine})
            assert abs(r.n_distinct - users) <= S.DISTINCT_ERROR * users
            for q, v in ((0.25, r.q25), (0.5, r.q50), (0.75, r.q75)):
                assert abs(sum(x <= v for x in values) / len(values) - q) <= S.RANK_ERROR


def test_merging_reads_no_rows(spark, tmp_dir):
    df = spark.range(100).selectExpr("'a' AS dataset", "id % 3 AS day", "id AS label", "id / 2.0D AS value")
    S.daily_sketches(df, "label", "value").write.parquet(f"{tmp_dir}/s")
    plan = S.read_sketches(S.merge_sketches(spark.read.parquet(f"{tmp_dir}/s")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Range" not in plan


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, None, None), ("a", 2, "x", 2.0), ("b", 1, None, None), (None, 1, "y", 1.0)],
                               "dataset string, day int, label string, value double")
    got = {r.dataset: r for r in S.read_sketches(S.merge_sketches(S.daily_sketches(df, "label", "value")), (0.5,)).collect()}
    assert (got["a"].n, got["a"].n_labels, got["a"].n_distinct, got["a"].q50) == (2, 1, 1, 2.0)
    assert (got["b"].n, got["b"].n_labels, got["b"].n_distinct, got["b"].q50) == (1, 0, 0, None)
    assert got[None].n_distinct == 1
    assert S.read_sketches(S.merge_sketches(S.daily_sketches(df.limit(0), "label", "value"))).collect() == []
    with pytest.raises(ColumnContractError):
        S.daily_sketches(df, "label", "nothing")


def test_sketches_of_one_day_equal_those_of_its_parts(spark):
    """A day closed twice (two halves) merges to the whole."""
    df = spark.range(5000).select(F.lit("a").alias("dataset"), F.lit(1).alias("day"), (F.col("id") % 700).alias("label"),
                                  F.rand(3).alias("value"))
    halves = S.daily_sketches(df.where("label < 300"), "label", "value").unionAll(
        S.daily_sketches(df.where("label >= 300"), "label", "value"))
    r = S.read_sketches(S.merge_sketches(halves)).first()
    assert r.n == 5000 and abs(r.n_distinct - 700) <= S.DISTINCT_ERROR * 700
