"""The staged job: ingest -> train -> predict -> analyze -> report.

Each stage is a function over DataFrames that reads the previous stage's
output from ``out_dir`` and writes its own there as parquet (overwrite, so
a rerun of a stage is idempotent). Writing at the stage borders also cuts
the lineage: a lost executor costs at most the current stage. ``out_dir``
must be shared storage on a cluster. ``ingest`` reads the document table;
``ingest_landed`` takes the landed pages, ranked items and issue lists instead.

Rows are counted while they are written. A manifest (``manifest.py``) closes every stage;
a stage refuses to run on outputs that do not belong together, and ``run(resume=True)``
starts at the first stage whose inputs or parameters changed.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded
from ..constants import DATASETS, PAGE_SIZE, PREVIEW_ROWS, TOP_K, TOP_STATS
from ..operators import clean as C
from ..operators import label_index as LI
from ..operators import metrics as M
from ..operators import naive_bayes as NB
from ..operators import nb_long as NL
from ..operators import shift as S
from ..operators import split as SP
from ..operators.observed import write_counted, write_observed
from ..session import scratch_scope
from ..sources.bucketed import read_bucketed, write_bucketed
from ..sources.files import write_parquet
from ..sources.lookup import issue_lists, issue_scan, ranked_lookup, read_json_arrays
from ..sources.paging import assemble_pages, read_landed_pages
from ..sources.tables import table_path
from ..sources.union import union_datasets
from . import manifest as MF
from . import views

MAX_LABELS = 100_000   # label index rows broadcast at most
STAGES = ("ingest", "train", "predict", "analyze", "report")
#: The stages whose outputs a stage reads.
READS = {"train": ("ingest",), "predict": ("ingest", "train"), "analyze": ("predict",), "report": ("train", "predict")}


def _p(out_dir: str, name: str) -> str:
    return os.path.join(out_dir, name)


def fresh_dir(parent: str) -> str:
    """A new folder name under a shared one."""
    return os.path.join(parent, f"run-{uuid.uuid4().hex}")


def _inputs(spark: SparkSession, out_dir: str, stage: str) -> str:
    """The run ids of what ``stage`` reads, after a check that these belong together."""
    found = {r: MF.read(spark, out_dir, r) for r in READS[stage]}
    for r, m in found.items():
        if m is None:
            raise RuntimeError(f"stage {stage!r} reads the output of {r!r}, which is missing or unfinished in {out_dir}")
        if r in READS and m.inputs != _inputs(spark, out_dir, r):
            raise RuntimeError(f"stage {stage!r} reads the output of {r!r}, which is older than what that was made from")
    return ",".join(f"{r}={m.run_id}" for r, m in found.items())


def _by_row(df: DataFrame, path: str, partition_by=None) -> None:
    """Texts, split and predictions lie by the hash of row_id: what joins them shuffles nothing."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(df, path, "row_id", buckets, partition_by or ())


def _texts_written(texts: DataFrame, out_dir: str) -> dict:
    """Write the texts with their load report; both come from one pass."""
    seen = write_observed(texts, _p(out_dir, "texts"), DATASETS, partition_by=["dataset"], write=_by_row)
    write_parquet(seen.coalesce(1), _p(out_dir, "load_report"))
    return {r.dataset: r.n_rows for r in seen.collect()}


def ingest(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Labelled texts of every dataset, partitioned by dataset."""
    MF.forget(spark, out_dir, "ingest")
    inputs = MF.digest(spark, table_path(sf_dir, "documents"))
    MF.record(spark, out_dir, "ingest", inputs, {}, _texts_written(views.texts(spark, sf_dir), out_dir))


def ingest_landed(spark: SparkSession, out_dir: str, pages: str | None = None, row_ddl: str = "text string, label string, id string",
                  ids: DataFrame | None = None, items: DataFrame | None = None, issues: str | None = None,
                  page_size: int = PAGE_SIZE, page_limit: int | None = None, id_limit: int | None = None,
                  per_page: int | None = 50) -> None:
    """The three landed inputs as one table of labelled texts: paged envelopes
    (in-domain), the items of a ranked id list, and issue lists. Texts are composed and
    empty ones dropped; missing cells are recognised; the first label is parsed."""
    MF.forget(spark, out_dir, "ingest")
    found = {}
    if pages:
        rows = assemble_pages(read_landed_pages(spark, pages, row_ddl), page_size, page_limit)
        rows = C.recognise_na(rows, [c for c, t in rows.dtypes if t == "string"])
        if "labels" in rows.columns:
            rows = C.with_first_label(rows, "labels", "label")
        found[DATASETS[0]] = rows.select(F.col("id").cast("string").alias("id"), "text", F.col("label").cast("string").alias("gold"))
    if ids is not None:
        found[DATASETS[1]] = ranked_lookup(ids, items, limit=id_limit).select(F.col("id").cast("string").alias("id"), "text")
    if issues:
        objs = issue_lists(read_json_arrays(spark, issues), keep=("file",), per_page=per_page)
        found[DATASETS[2]] = issue_scan(objs, order_cols=("file", "pos")).select(F.col("id").cast("string").alias("id"), "text")
    texts = C.drop_empty_text(union_datasets(found))
    if "gold" not in texts.columns:
        texts = texts.withColumn("gold", F.lit(None).cast("string"))
    texts = texts.select(F.concat_ws("/", "dataset", "id").alias("row_id"), "text", "gold", "dataset")
    inputs, params = _landed_key(spark, pages, row_ddl, ids, items, issues, page_size, page_limit, id_limit, per_page)
    MF.record(spark, out_dir, "ingest", inputs, params, _texts_written(texts, out_dir))


def _landed_key(spark: SparkSession, pages=None, row_ddl="text string, label string, id string", ids=None, items=None,
                issues=None, page_size=PAGE_SIZE, page_limit=None, id_limit=None, per_page=50) -> tuple[str, dict]:
    """What tells one landed input from another: the files of the paths and of the tables
    given, and the parameters. A table that is not read from files is known by its plan."""
    paths = [p for p in (pages, issues) if p]
    for t in (ids, items):
        if t is not None:
            paths += [f for f in t.inputFiles()]
    plans = "".join(str(t.semanticHash()) for t in (ids, items) if t is not None and not t.inputFiles())
    return MF.digest(spark, *paths) + plans, {
        "row_ddl": row_ddl, "page_size": page_size, "page_limit": page_limit, "id_limit": id_limit, "per_page": per_page}


def train(spark: SparkSession, out_dir: str) -> None:
    inputs = _inputs(spark, out_dir, "train")
    MF.forget(spark, out_dir, "train")
    texts = read_bucketed(spark, _p(out_dir, "texts"))
    ind = C.drop_missing(texts.filter(F.col("dataset") == DATASETS[0]), ["text", "gold"])
    plan = SP.plan_split(ind, "gold", "row_id")
    split = plan.assign(ind)
    counts = write_counted(split.select("row_id", "gold", "split"), _p(out_dir, "split"), write=_by_row,
                           train=F.col("split") == "train", val=F.col("split") == "val")
    train_rows = split.filter(F.col("split") == "train")
    write_parquet(LI.label_index(ind, "gold"), _p(out_dir, "label_index"))
    # one column per class up to the wide model's bound, one row per pair seen beyond
    wide = plan.quotas.limit(NB.MAX_CLASSES + 1).count() <= NB.MAX_CLASSES
    if wide:
        NB.save_nb(NB.fit_nb(train_rows, None, "gold", "text", class_docs=plan.train_docs(NB.MAX_CLASSES)),
                   _p(out_dir, "model"))
    else:
        NL.save_nb_long(NL.fit_nb_long(train_rows, "gold", "text"), _p(out_dir, "model"))
    write_parquet(spark.createDataFrame([(wide,)], "wide boolean"), _p(out_dir, "model_kind"))
    MF.record(spark, out_dir, "train", inputs, {"max_classes": NB.MAX_CLASSES}, counts)


def predicted(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every text with the saved model's prediction and its split. Texts and split lie by
    row_id, the scores are summed where the texts lie, so no row of them is shuffled (but
    for the rare words of a model above its broadcast bound)."""
    texts = read_bucketed(spark, _p(out_dir, "texts"))
    if spark.read.parquet(_p(out_dir, "model_kind")).first().wide:
        scored = NB.score_nb(NB.load_nb(spark, _p(out_dir, "model")), texts)
    else:
        scored = NL.score_nb_long(NL.load_nb_long(spark, _p(out_dir, "model")), texts)
    scored = scored.select("row_id", "pred_label", "pred_confidence")
    split = read_bucketed(spark, _p(out_dir, "split")).select("row_id", "split")
    return texts.join(scored, "row_id").join(split, "row_id", "left").withColumn("split", F.coalesce("split", F.lit("ood")))


def predict(spark: SparkSession, out_dir: str) -> None:
    """Score every text with the saved model; the inputs are kept, the split attached."""
    inputs = _inputs(spark, out_dir, "predict")
    MF.forget(spark, out_dir, "predict")
    counts = write_counted(predicted(spark, out_dir), _p(out_dir, "predictions"), partition_by=["dataset"], rows=F.lit(True),
                           correct=F.col("gold").eqNullSafe(F.col("pred_label")))
    MF.record(spark, out_dir, "predict", inputs, {}, counts)


def analyze(spark: SparkSession, out_dir: str) -> None:
    """Per-dataset evaluation over every prediction (the in-domain rows are
    one dataset among the others), accuracy over all, per dataset and per split,
    macro-F1, and the validation metrics of the classifier."""
    inputs = _inputs(spark, out_dir, "analyze")
    MF.forget(spark, out_dir, "analyze")
    pred = spark.read.parquet(_p(out_dir, "predictions"))
    by = ["dataset"]
    stats = M.label_stats(pred, by=by, sort=False)
    write_parquet(stats, _p(out_dir, "analysis/label_stats"))
    write_parquet(M.top_n(stats, PREVIEW_ROWS, group=by), _p(out_dir, "analysis/preview"))
    write_parquet(M.overall_accuracy(pred, by=by), _p(out_dir, "analysis/accuracy"))
    write_parquet(M.overall_accuracy(pred, by=["dataset", "split"]), _p(out_dir, "analysis/accuracy_by_split"))
    write_parquet(M.macro_f1(pred, by=by), _p(out_dir, "analysis/macro_f1"))
    write_parquet(M.evaluate(pred.filter(F.col("split") == "val")), _p(out_dir, "analysis/validation"))
    MF.record(spark, out_dir, "analyze", inputs, {}, {})


def report(spark: SparkSession, out_dir: str, top_k: int = TOP_K, group_labels=()) -> None:
    """Data of the charts. ``group_labels``: labels kept apart in the grouped shares."""
    inputs = _inputs(spark, out_dir, "report")
    MF.forget(spark, out_dir, "report")
    pred = spark.read.parquet(_p(out_dir, "predictions"))
    idx = spark.read.parquet(_p(out_dir, "label_index"))
    n_labels = idx.count()                         # label-level table
    dist = S.label_distribution(pred, sort=False)
    write_parquet(S.wide_distribution(dist, DATASETS), _p(out_dir, "report/distribution"))
    top = M.top_n(M.label_stats(pred, label_name="gold_label", by=["dataset"], sort=False), TOP_STATS,
                  label_name="gold_label", group=["dataset"])
    write_parquet(top, _p(out_dir, "report/top_labels"))
    write_parquet(S.label_groups(dist, DATASETS, keep=group_labels), _p(out_dir, "report/label_groups"))
    conf = S.confusion_topk(pred, top_k, by=["dataset"])
    write_parquet(S.confusion_normalise(conf, by=["dataset"]), _p(out_dir, "report/confusion"))
    # Dense vectors need the label ids 0..C-1: map predictions through the index.
    small = broadcast_if_bounded(idx.select(F.col("label").alias("pred_label"), "label_idx"),
                                 MAX_LABELS)
    pidx = pred.join(small, "pred_label", "left")
    dense = S.dense_distribution(pidx, n_labels, DATASETS, label="label_idx")
    write_parquet(S.distribution_corr(dense, DATASETS), _p(out_dir, "report/correlation"))
    write_parquet(S.confidence_histogram(pred, DATASETS), _p(out_dir, "report/confidence_hist"))
    MF.record(spark, out_dir, "report", inputs, {"top_k": top_k, "group_labels": list(group_labels)}, {})


def run(spark: SparkSession, sf_dir: str | None, out_dir: str, stages=STAGES, resume: bool = False,
        landed: dict | None = None, report_params: dict | None = None) -> dict:
    """Run ``stages`` in their order; each maps to ``out_dir`` in the result if it ran and
    to None if ``resume`` found it up to date. ``landed`` (arguments of ``ingest_landed``)
    takes the landed inputs instead of the document table of ``sf_dir``."""
    report_params = report_params or {}
    done = {}
    for st in STAGES:
        if st not in stages:
            continue
        if resume and _up_to_date(spark, sf_dir, out_dir, st, landed, report_params):
            done[st] = None
            continue
        with scratch_scope(spark):   # a stage has written its outputs when it returns
            if st == "ingest":
                if landed is None:
                    ingest(spark, sf_dir, out_dir)
                else:
                    ingest_landed(spark, out_dir, **landed)
            elif st == "train":
                train(spark, out_dir)
            elif st == "predict":
                predict(spark, out_dir)
            elif st == "analyze":
                analyze(spark, out_dir)
            else:
                report(spark, out_dir, **report_params)
        done[st] = out_dir
    return done


def _up_to_date(spark, sf_dir, out_dir, stage, landed, report_params) -> bool:
    m = MF.read(spark, out_dir, stage)
    if m is None:
        return False
    params = {}
    if stage == "ingest":
        if landed is None:
            inputs = MF.digest(spark, table_path(sf_dir, "documents"))
        else:
            inputs, params = _landed_key(spark, **landed)
    else:
        inputs = _inputs(spark, out_dir, stage)
        if stage == "train":
            params = {"max_classes": NB.MAX_CLASSES}
        elif stage == "report":
            params = {"top_k": report_params.get("top_k", TOP_K),
                      "group_labels": list(report_params.get("group_labels", ()))}
    return (m.inputs, m.params) == (inputs, json.dumps(params, sort_keys=True, default=str))
