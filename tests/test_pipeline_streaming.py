"""Staged pipeline end to end, NB persistence, streaming scoring."""

import os

from pyspark.sql import functions as F

from driftlens.operators import naive_bayes as NB
from driftlens.operators import split as SP
from driftlens.plans import pipeline, views
from driftlens.streaming.scoring import score_stream, scored_distribution
from tests.conftest import SF_SMALL


def test_pipeline_runs_all_stages(spark, tmp_dir):
    out = os.path.join(tmp_dir, "run")
    done = pipeline.run(spark, SF_SMALL, out)
    assert list(done) == list(pipeline.STAGES)
    pred = spark.read.parquet(os.path.join(out, "predictions"))
    assert pred.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    stats = spark.read.parquet(os.path.join(out, "analysis/label_stats"))
    support = {r.dataset: r.n for r in stats.groupBy("dataset").agg(F.sum("support").alias("n")).collect()}
    assert support == {r.dataset: r["count"] for r in pred.groupBy("dataset").count().collect()}
    conf = spark.read.parquet(os.path.join(out, "report/confusion"))
    assert {r.dataset for r in conf.select("dataset").distinct().collect()} == set(support)
    corr = spark.read.parquet(os.path.join(out, "report/correlation")).collect()
    assert len(corr) == 9
    hist = spark.read.parquet(os.path.join(out, "report/confidence_hist"))
    assert hist.agg(F.sum("n")).first()[0] == pred.count()


def test_nb_save_load_roundtrip(spark, tmp_dir):
    texts = views.texts(spark, SF_SMALL)
    train = SP.stratified_split(texts.filter("dataset = 'indomain'"), "gold", "row_id") \
        .filter("split = 'train'")
    m = NB.fit_nb(train)
    NB.save_nb(m, os.path.join(tmp_dir, "nb"))
    m2 = NB.load_nb(spark, os.path.join(tmp_dir, "nb"))
    assert m2.classes == m.classes and m2.log_prior == m.log_prior
    a = {r.row_id: r.pred_label for r in NB.score_nb(m, texts).collect()}
    b = {r.row_id: r.pred_label for r in NB.score_nb(m2, texts).collect()}
    assert a == b


def test_stream_scoring_matches_batch(spark, tmp_dir):
    texts = views.texts(spark, SF_SMALL)
    train = SP.stratified_split(texts.filter("dataset = 'indomain'"), "gold", "row_id") \
        .filter("split = 'train'")
    model = NB.fit_nb(train)
    src = os.path.join(tmp_dir, "landing")
    # Two landed files (two separate writes) picked up incrementally.
    texts.filter("row_id % 2 = 0").write.mode("append").parquet(src)
    texts.filter("row_id % 2 = 1").write.mode("append").parquet(src)
    schema = "row_id long, text string, gold string, dataset string"
    out = os.path.join(tmp_dir, "scored")
    q = score_stream(spark, model, src, schema, out, os.path.join(tmp_dir, "ck"),
                     keep=("dataset", "gold"), max_files_per_trigger=1)
    q.awaitTermination(300)
    got = {r.row_id: r.pred_label for r in spark.read.parquet(out).collect()}
    want = {r.row_id: r.pred_label for r in NB.score_nb(model, texts).collect()}
    assert got == want
    total = lambda: sum(r.n for r in scored_distribution(spark, out).collect())
    assert total() == len(want)
    # an epoch that is scored again is not counted twice
    epoch = spark.read.parquet(os.path.join(out, "epoch=0"))
    rows = epoch.collect()
    spark.createDataFrame(rows, epoch.schema).write.mode("overwrite").parquet(os.path.join(out, "epoch=0"))
    assert total() == len(want)


def test_pipeline_from_landed_inputs(spark, tmp_dir):
    import json
    land = os.path.join(tmp_dir, "land")
    os.makedirs(os.path.join(land, "pages"))
    text = {0: "red apple fruit", 1: "blue whale sea", 2: "green leaf tree"}
    for p in range(3):
        rows = [{"row": {"id": str(p * 10 + i), "labels": f"[{i % 3}]", "text": text[i % 3] + f" {i}"}} for i in range(10)]
        with open(os.path.join(land, "pages", f"page-{p}.json"), "w") as f:
            json.dump({"rows": rows}, f)
    with open(os.path.join(land, "issues.json"), "w") as f:
        json.dump([{"id": 1, "title": "sea", "body": "whale", "state": "open", "user": None},
                   {"id": 2, "title": "pr", "state": "open", "pull_request": None}], f)
    ids = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "pos long, id long")
    items = spark.createDataFrame([(5, "apple", "red"), (6, " ", None)], "id long, title string, text string")
    out = os.path.join(tmp_dir, "landed")
    pipeline.ingest_landed(spark, out, os.path.join(land, "pages"), "id string, labels string, text string", ids, items,
                           os.path.join(land, "issues.json"), page_size=10)
    pipeline.run(spark, SF_SMALL, out, stages=("train", "predict", "analyze", "report"))
    pred = {r.row_id: r for r in spark.read.parquet(os.path.join(out, "predictions")).collect()}
    assert len(pred) == 32 and {r.dataset for r in pred.values()} == {"indomain", "ood_a", "ood_b"}
    assert pred["ood_a/5"].text == "apple red" and pred["ood_a/5"].pred_label == "0"
    assert pred["ood_b/1"].pred_label == "1"
    acc = {r.dataset: r.accuracy for r in spark.read.parquet(os.path.join(out, "analysis/accuracy")).collect()}
    assert acc["indomain"] == 1.0
    for name in ("analysis/preview", "analysis/accuracy_by_split", "analysis/macro_f1", "analysis/validation",
                 "report/distribution", "report/top_labels", "report/label_groups", "report/confusion",
                 "report/correlation", "report/confidence_hist"):
        assert spark.read.parquet(os.path.join(out, name)).count() > 0, name
