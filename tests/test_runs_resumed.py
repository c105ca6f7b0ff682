"""Manifests, resumed runs, observed counts and positional alignment."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftlens.constants import DATASETS
from driftlens.operators import metrics as M
from driftlens.operators import naive_bayes as NB
from driftlens.operators import observed as OB
from driftlens.plans import manifest as MF
from driftlens.plans import pipeline as P
from driftlens.plans import views
from driftlens.session import ensure_checkpoint_dir, scratch_path, scratch_scope
from driftlens.sources import positions as PO
from tests.conftest import SF_SMALL


# ---- manifests and resumed runs ------------------------------------------------------------

def stages_run(done):
    return [s for s, out in done.items() if out]


def test_resume_starts_at_the_first_changed_stage(spark, tmp_dir, monkeypatch):
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{src}/documents.parquet")
    assert stages_run(P.run(spark, src, out, resume=True)) == list(P.STAGES)
    assert stages_run(P.run(spark, src, out, resume=True)) == []
    # other parameters of the last stage, then a bound that makes the model another one
    assert stages_run(P.run(spark, src, out, resume=True, report_params={"top_k": 3})) == ["report"]
    wide = {r.row_id: r.pred_label for r in spark.read.parquet(f"{out}/predictions").collect()}
    monkeypatch.setattr(NB, "MAX_CLASSES", 2)
    assert stages_run(P.run(spark, src, out, resume=True, report_params={"top_k": 3})) == list(P.STAGES[1:])
    assert {r.row_id: r.pred_label for r in spark.read.parquet(f"{out}/predictions").collect()} == wide
    # new rows
    docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000).write.mode("append").parquet(f"{src}/documents.parquet")
    assert stages_run(P.run(spark, src, out, resume=True)) == list(P.STAGES)
    assert MF.read(spark, out, "predict").counts["rows"] == docs.count() + 5


def test_a_run_killed_in_a_stage_resumes_there(spark, tmp_dir, monkeypatch):
    out = f"{tmp_dir}/out"

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(P, "write_counted", killed)
    with pytest.raises(KeyboardInterrupt):
        P.run(spark, SF_SMALL, out)
    monkeypatch.undo()
    assert MF.read(spark, out, "ingest") and MF.read(spark, out, "train") is None
    assert stages_run(P.run(spark, SF_SMALL, out, resume=True)) == list(P.STAGES[1:])
    # killed while writing the manifest itself: no marker, no manifest
    os.remove(f"{out}/manifest/predict/_SUCCESS")
    assert stages_run(P.run(spark, SF_SMALL, out, resume=True)) == ["predict", "analyze", "report"]


def test_outputs_that_do_not_belong_together_are_refused(spark, tmp_dir):
    out = f"{tmp_dir}/out"
    with pytest.raises(RuntimeError, match="missing or unfinished"):
        P.run(spark, SF_SMALL, out, stages=("predict",))
    P.run(spark, SF_SMALL, out, stages=("ingest", "train"))
    P.run(spark, SF_SMALL, out, stages=("ingest",))
    with pytest.raises(RuntimeError, match="older than"):
        P.run(spark, SF_SMALL, out, stages=("predict",))
    P.run(spark, SF_SMALL, out, stages=("train", "predict"))


def test_a_run_leaves_no_scratch_tables(spark, tmp_dir):
    shared = spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    folder = shared.removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("scratch-")}
    P.run(spark, SF_SMALL, f"{tmp_dir}/out", stages=("ingest", "train", "predict"))
    assert {f for f in os.listdir(folder) if f.startswith("scratch-")} <= before
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        path = scratch_path(spark, "scratch")
        spark.range(3).write.parquet(path)
        with scratch_scope(spark):
            spark.range(3).write.parquet(scratch_path(spark, "scratch"))
        assert os.path.isdir(path.removeprefix("file:"))
        1 / 0
    assert {f for f in os.listdir(folder) if f.startswith("scratch-")} <= before


def test_counts_of_a_run(spark, tmp_dir):
    out = f"{tmp_dir}/out"
    P.run(spark, SF_SMALL, out, stages=("ingest", "train", "predict"))
    texts = views.texts(spark, SF_SMALL).collect()
    n = Counter(r.dataset for r in texts)
    assert MF.read(spark, out, "ingest").counts == {d: n[d] for d in DATASETS}
    split = Counter(r.split for r in spark.read.parquet(f"{out}/split").collect())
    assert MF.read(spark, out, "train").counts == dict(split)
    pred = spark.read.parquet(f"{out}/predictions").collect()
    assert MF.read(spark, out, "predict").counts == {
        "rows": len(texts), "correct": sum(r.gold == r.pred_label for r in pred)}
    report = {r.dataset: r for r in spark.read.parquet(f"{out}/load_report").collect()}
    assert {d: r.n_chars for d, r in report.items()} == {
        d: sum(len(r.text or "") for r in texts if r.dataset == d) for d in DATASETS}


def test_landed_inputs_resume(spark, tmp_dir):
    land, out = f"{tmp_dir}/land", f"{tmp_dir}/out"
    os.makedirs(f"{land}/pages")

    def page(p):
        rows = [{"row": {"id": str(p * 10 + i), "labels": f"[{i % 2}]", "text": ["red apple", "blue sea"][i % 2]}}
                for i in range(10)]
        with open(f"{land}/pages/page-{p}.json", "w") as f:
            json.dump({"rows": rows}, f)

    page(0)
    landed = {"pages": f"{land}/pages", "row_ddl": "id string, labels string, text string", "page_size": 10}
    go = lambda **kw: stages_run(P.run(spark, None, out, stages=P.STAGES[:3], resume=True, landed={**landed, **kw}))
    assert go() == list(P.STAGES[:3]) and go() == []
    page(1)
    assert go() == list(P.STAGES[:3]) and MF.read(spark, out, "ingest").counts["indomain"] == 20
    assert go(page_limit=15) == list(P.STAGES[:3])
    assert MF.read(spark, out, "ingest").counts["indomain"] == 15


# ---- observed counts -----------------------------------------------------------------------

def test_load_report_counts_while_writing(spark, tmp_dir):
    rows = [("a", "x y", "p"), ("a", None, None), ("a", " ", "p"), ("b", "", None)]
    df = spark.createDataFrame(rows, "dataset string, text string, gold string")
    got = OB.write_observed(df, f"{tmp_dir}/t", ["a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [("a", 3, 1, 1, 1, 4), ("b", 1, 0, 1, 1, 0), ("c", 0, 0, 0, 0, 0)]
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 4
    with pytest.raises(Exception, match="dataset outside"):
        OB.write_observed(df, f"{tmp_dir}/u", ["a"])
    assert [r.n_rows for r in OB.write_observed(df.limit(0), f"{tmp_dir}/v", ["a"]).collect()] == [0]


def test_load_report_is_one_scan(spark):
    spark.catalog.clearCache()  # other tests may have cached the texts
    rows, _ = OB.observe_load(views.texts(spark, SF_SMALL), DATASETS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan


def test_alignment_report(spark, tmp_dir):
    gold = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (3, None), (None, 1)], "row_id long, gold int")
    pred = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 9), (4, 9)], "row_id long, pred_label int")
    got = OB.write_aligned(gold, pred, f"{tmp_dir}/a").first()
    assert got.asDict() == {"n_gold": 5, "n_pred": 5, "n_aligned": 3, "n_gold_only": 1, "n_pred_only": 1,
                            "n_gold_again": 1, "n_pred_again": 1, "n_correct": 3}
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_dir}/a").collect()) == [(1, 5, 5), (2, 6, 6), (3, None, None)]
    none = OB.write_aligned(gold.limit(0), pred.limit(0), f"{tmp_dir}/b").first()
    assert set(none.asDict().values()) == {0}


# ---- positions -----------------------------------------------------------------------------

def test_names_in_order():
    names = ["d/part-100000-x.csv", "d/part-99999-x.csv", "d/part-00002-x.csv", "c/part-00010", "d/a"]
    assert sorted(names, key=PO.name_order) == ["c/part-00010", "d/a", "d/part-00002-x.csv", "d/part-99999-x.csv",
                                               "d/part-100000-x.csv"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("files", [1, 7])
def test_positions_are_dense_and_in_file_order(spark, tmp_dir, fmt, files):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), F.concat(F.lit("a,\n\""), F.col("id")).alias("t"))
    PO.write_in_order(df.repartition(5), f"{tmp_dir}/x", "k", files, fmt)
    if fmt == "csv":
        got = PO.number_csv(spark, f"{tmp_dir}/x", "k long, t string")
    else:
        got = PO.number_parquet(spark, f"{tmp_dir}/x", ["k", "t"])
    assert got.n == 1000 and got.rows.columns == ["k", "t", "position"]
    rows = got.rows.collect()
    assert sorted((r.position, r.k, r.t) for r in rows) == [(i, 3 * i, f'a,\n"{i}') for i in range(1000)]
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_positions_of_split_files(spark, tmp_dir):
    """A file read in several splits, and row groups that a filter skips."""
    spark.range(200_000).coalesce(1).write.option("parquet.block.size", 65536).parquet(f"{tmp_dir}/p")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = PO.number_parquet(spark, f"{tmp_dir}/p", ["id"])
        assert got.rows.rdd.getNumPartitions() > 1
        assert got.rows.where("id <> position").count() == 0 and got.n == 200_000
        assert got.rows.where("id >= 199990").count() == 10
        assert got.rows.where("id = 150000").first().position == 150_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_positional_alignment_refuses_other_counts(spark, tmp_dir):
    for name, n, files in (("g", 100, 3), ("p", 100, 2), ("q", 99, 2)):
        PO.write_in_order(spark.range(n).select(F.col("id").alias("x" + name)), f"{tmp_dir}/{name}", "x" + name, files)
    g, p, q = (PO.number_parquet(spark, f"{tmp_dir}/{n}", ["x" + n]) for n in "gpq")
    both = M.gold_pred_positional(g, p).collect()
    assert len(both) == 100 and all(r.xg == r.xp == r.position for r in both)
    with pytest.raises(ValueError, match="100 gold rows, but 99 prediction rows"):
        M.gold_pred_positional(g, q)


def test_positions_of_an_empty_table(spark, tmp_dir):
    spark.range(0).write.parquet(f"{tmp_dir}/e")
    got = PO.number_parquet(spark, f"{tmp_dir}/e", ["id"])
    assert got.n == 0 and got.rows.count() == 0
