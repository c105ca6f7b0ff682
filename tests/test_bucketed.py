"""Tables laid out by a key: round trip, a new session's view of them, and joins without a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from driftlens.plans import pipeline as P
from driftlens.sources import bucketed as B
from tests.conftest import SF_SMALL


@pytest.fixture()
def no_broadcast(spark):
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    yield
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)


def shuffles(df) -> list[str]:
    df.collect()
    return re.findall(r"Exchange hashpartitioning\([^)]*\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("folders", [(), ("dataset",)])
def test_round_trip_and_overwrite(spark, tmp_dir, folders):
    df = spark.range(100).select(F.concat(F.lit("r"), "id").alias("row_id"), F.array("id").alias("x"),
                                 F.when(F.col("id") % 3 == 0, "it's").otherwise("b").alias("dataset"))
    path = f"{tmp_dir}/it's"
    for rows in (df, df.limit(10), df.limit(0)):
        B.write_bucketed(rows, path, "row_id", 4, folders)
        got = B.read_bucketed(spark, path)
        assert sorted(got.columns) == sorted(df.columns)
        assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, rows.collect()))
    assert not spark.catalog.listTables() or all(t.name.startswith("bucketed_") for t in spark.catalog.listTables())


def test_joins_and_groupings_on_the_key_do_not_shuffle(spark, tmp_dir, no_broadcast):
    a = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("a"))
    B.write_bucketed(a, f"{tmp_dir}/a", "row_id", 4)
    B.write_bucketed(a.withColumnRenamed("a", "b"), f"{tmp_dir}/b", "row_id", 4)
    x, y = B.read_bucketed(spark, f"{tmp_dir}/a"), B.read_bucketed(spark, f"{tmp_dir}/b")
    both = x.join(y, "row_id").groupBy("row_id").agg(F.sum("a").alias("s"))
    assert shuffles(both) == [] and both.count() == 1000
    plain = spark.read.parquet(f"{tmp_dir}/a").join(spark.read.parquet(f"{tmp_dir}/b"), "row_id")
    assert len(shuffles(plain)) >= 2   # the initial and the final plan name them


def test_predictions_are_joined_where_the_texts_lie(spark, tmp_dir, no_broadcast):
    out = f"{tmp_dir}/out"
    P.run(spark, SF_SMALL, out, stages=("ingest", "train", "predict"))
    df = P.predicted(spark, out)
    assert [s for s in shuffles(df) if "row_id" in s] == []
    want = {r.row_id: r.pred_label for r in spark.read.parquet(f"{out}/predictions").collect()}
    assert {r.row_id: r.pred_label for r in df.collect()} == want and len(want) == 200
