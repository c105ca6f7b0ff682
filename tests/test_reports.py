"""Metrics and domain-shift reports: properties, edge cases, invariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.constants import DATASETS
from driftlens.functions.scores import argmax, softmax
from driftlens.operators import metrics as M
from driftlens.operators import shift as S
from driftlens.plans import views
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def scored(spark):
    return views.scored(spark, SF_SMALL).cache()


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],), ([0.0],), ([5.0, 1.0],)], "z array<double>")
    rows = df.select(softmax("z").alias("p"), argmax("z").alias("a")).collect()
    for r, z in zip(rows, [[1.0, 3.0, 3.0, -2.0], [0.0], [5.0, 1.0]]):
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(r.p, e / e.sum())
        assert math.isclose(sum(r.p), 1.0)
        assert r.a == int(np.argmax(z))     # first index on ties


def test_correct_flag_is_null_safe(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (2, 3)], "gold int, pred_label int")
    assert [r.correct for r in M.correct_flag(df).collect()] == [1, 0, 1, 0]
    acc = M.overall_accuracy(df).first()
    assert acc.n_total == 4 and acc.n_correct == 2 and acc.accuracy == 0.5


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "gold int, pred_label int, dataset string, pred_confidence double")
    assert M.label_stats(empty).count() == 0
    r = M.overall_accuracy(empty).first()
    assert r.n_total == 0 and r.accuracy is None
    assert S.confidence_histogram(empty, DATASETS).count() == 0
    assert S.confusion_topk(empty, 3).count() == 0


def test_macro_f1_against_definition(spark):
    gold = [0, 0, 1, 1, 2, 2, 2, 3]
    pred = [0, 1, 1, 1, 0, 2, 4, 3]
    df = spark.createDataFrame(list(zip(gold, pred)), "gold int, pred_label int")
    labels = sorted(set(gold) | set(pred))
    f1s = []
    for lab in labels:
        tp = sum(g == p == lab for g, p in zip(gold, pred))
        s = gold.count(lab)
        q = pred.count(lab)
        f1s.append(2 * tp / (s + q) if s + q else 0.0)
    got = M.macro_f1(df).first()
    assert math.isclose(got.f1_macro, sum(f1s) / len(f1s))
    assert got.n_labels == len(labels)


def test_distributions_sum_to_one(scored):
    dist = S.label_distribution(scored)
    for r in dist.groupBy("dataset").agg(F.sum("p").alias("s")).collect():
        assert math.isclose(r.s, 1.0, abs_tol=1e-12)
    wide = S.wide_distribution(dist, DATASETS).collect()
    for d in ("indomain", "ood_a", "ood_b"):
        assert math.isclose(sum(r[d] for r in wide), 1.0, abs_tol=1e-12)
    groups = S.label_groups(dist, DATASETS, keep=(9, 0)).collect()
    assert [r.label_group for r in groups] == ["9", "0", "others"]
    for d in ("indomain", "ood_a", "ood_b"):
        assert math.isclose(sum(r[d] for r in groups), 1.0, abs_tol=1e-12)


def test_label_groups_always_reports_every_group(spark):
    df = spark.createDataFrame([("indomain", 3), ("ood_a", 3), ("ood_b", 4)], "dataset string, pred_label int")
    g = S.label_groups(S.label_distribution(df), DATASETS, keep=(27, 0)).collect()
    assert [r.label_group for r in g] == ["27", "0", "others"]
    assert g[0].indomain == 0.0 and g[2].indomain == 1.0


def test_dense_domain_drops_outside_ids(spark):
    df = spark.createDataFrame([("indomain", 1), ("indomain", 30), ("ood_a", -1), ("ood_b", 2)],
                               "dataset string, pred_label int")
    d = S.dense_distribution(df, 5, DATASETS).collect()
    assert len(d) == 15
    ood_a = [r.p for r in d if r.dataset == "ood_a"]
    assert ood_a == [0.0] * 5          # zero vector stays zero
    assert sum(r.p for r in d if r.dataset == "indomain") == 1.0


def test_corr_symmetric_unit_diagonal_and_constant_vectors(spark, scored):
    dense = S.dense_distribution(scored, 10, DATASETS)
    c = {(r.ds_a, r.ds_b): r.corr for r in S.distribution_corr(dense, DATASETS).collect()}
    for (a, b), v in c.items():
        assert math.isclose(v, c[(b, a)], abs_tol=1e-12)
        if a == b:
            assert math.isclose(v, 1.0, abs_tol=1e-9)
    # A constant vector (all predictions of ood_b outside the domain).
    df = spark.createDataFrame([("indomain", 1), ("indomain", 2), ("indomain", 2), ("ood_a", 0),
                                ("ood_a", 2), ("ood_b", 7)], "dataset string, pred_label int")
    c2 = {(r.ds_a, r.ds_b): r.corr for r in S.distribution_corr(S.dense_distribution(df, 3, DATASETS), DATASETS).collect()}
    assert c2[("ood_b", "indomain")] is None and c2[("ood_b", "ood_b")] is None
    v = np.corrcoef([[0, 1 / 3, 2 / 3], [0.5, 0, 0.5]])[0, 1]
    assert math.isclose(c2[("indomain", "ood_a")], v, abs_tol=1e-9)


def test_confusion_rows_sum_to_one_or_zero(spark, scored):
    ind = scored.filter("dataset = 'indomain'")
    conf = S.confusion_normalise(S.confusion_topk(ind, 4))
    rows = conf.groupBy("gold").agg(F.sum("p").alias("s"), F.count("*").alias("k")).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.k == 4
        assert math.isclose(r.s, 1.0, abs_tol=1e-12) or r.s == 0.0
    # a zero row: gold 1 is frequent but never predicted inside the top-k
    df = spark.createDataFrame([(1, 9)] * 5 + [(2, 2)] * 3, "gold int, pred_label int")
    z = {(r.gold, r.pred): r.p for r in S.confusion_normalise(S.confusion_topk(df, 2)).collect()}
    assert z[(1, 1)] == 0.0 and z[(1, 2)] == 0.0 and z[(2, 2)] == 1.0


def test_histogram_matches_numpy(spark, scored):
    h = S.confidence_histogram(scored, DATASETS).collect()
    pdf = scored.select("dataset", "pred_confidence").toPandas()
    for d in ("indomain", "ood_a", "ood_b"):
        vals = pdf[pdf.dataset == d].pred_confidence.to_numpy()
        counts, edges = np.histogram(vals, bins=20)
        got = sorted((r.bin, r.n, r.bin_lo, r.bin_hi) for r in h if r.dataset == d)
        assert [g[1] for g in got] == counts.tolist()
        assert np.allclose([g[2] for g in got], edges[:-1]) and np.allclose([g[3] for g in got], edges[1:])


def test_histogram_single_value_and_edges(spark):
    df = spark.createDataFrame([("indomain", 0.5)] * 3 + [("ood_a", 0.0), ("ood_a", 1.0), ("ood_a", 0.05),
                               ("ood_a", 0.5)], "dataset string, pred_confidence double")
    h = {(r.dataset, r.bin): r.n for r in S.confidence_histogram(df, DATASETS).collect()}
    assert h[("indomain", 10)] == 3 and sum(v for (d, _), v in h.items() if d == "indomain") == 3
    counts, _ = np.histogram([0.0, 1.0, 0.05, 0.5], bins=20)
    assert [h[("ood_a", b)] for b in range(20)] == counts.tolist()


def test_gold_pred_join_asserts_alignment(spark):
    gold = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, gold int")
    pred = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, pred_label int")
    assert M.gold_pred_join(gold, pred).count() == 2
    bad = spark.createDataFrame([(1, 0), (3, 1)], "row_id long, pred_label int")
    with pytest.raises(Exception, match="not aligned"):
        M.gold_pred_join(gold, bad).collect()
    dup = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "row_id long, pred_label int")
    with pytest.raises(Exception, match="duplicate"):
        M.gold_pred_join(gold, dup).collect()


@pytest.mark.parametrize("parts", [1, 17])
def test_invariance_under_repartitioning(spark, scored, parts):
    base = sorted(tuple(r) for r in M.label_stats(scored).collect())
    re = scored.repartition(parts)
    assert sorted(tuple(r) for r in M.label_stats(re).collect()) == base
    a = sorted(tuple(r) for r in S.confusion_topk(scored, 5).collect())
    assert sorted(tuple(r) for r in S.confusion_topk(re, 5).collect()) == a
    # the per-dataset forms used by the registered queries
    by = ["dataset"]
    for rep in (lambda d: M.top_n(M.label_stats(d, by=by), 3, group=by),
                lambda d: M.topk_labels(d, 4, by=by),
                lambda d: S.confusion_normalise(S.confusion_topk(d, 3, by=by), by=by)):
        assert sorted(tuple(r) for r in rep(re).collect()) == \
            sorted(tuple(r) for r in rep(scored).collect())


def test_grouped_reports_equal_per_group_runs(spark, scored):
    """Each ``by``-grouped report equals the ungrouped operator run on that
    group's rows alone (NULL gold and predicted labels included)."""
    extra = spark.createDataFrame(
        [(10_000, None, "ood_a", 3), (10_001, 3, "ood_a", None), (10_002, None, "ood_b", None)],
        "row_id long, gold int, dataset string, pred_label int")
    df = scored.select("row_id", "gold", "dataset", "pred_label").unionByName(extra)
    by = ["dataset"]
    datasets = [r.dataset for r in df.select("dataset").distinct().collect()]

    def grouped(rep, cols):
        return sorted(tuple(r[c] for c in cols) for r in rep.collect())

    def per_group(fn, cols):
        out = []
        for d in datasets:
            out += [(d, *[r[c] for c in cols]) for r in fn(df.filter(F.col("dataset") == d)).collect()]
        return sorted(out)

    conf_cols = ["gold", "pred", "n"]
    assert grouped(S.confusion_topk(df, 3, by=by), ["dataset", *conf_cols]) == \
        per_group(lambda x: S.confusion_topk(x, 3), conf_cols)
    norm_cols = ["gold", "pred", "p"]
    assert grouped(S.confusion_normalise(S.confusion_topk(df, 3, by=by), by=by),
                   ["dataset", *norm_cols]) == \
        per_group(lambda x: S.confusion_normalise(S.confusion_topk(x, 3)), norm_cols)
    top_cols = ["label", "n", "rank"]
    assert grouped(M.topk_labels(df, 4, by=by), ["dataset", *top_cols]) == \
        per_group(lambda x: M.topk_labels(x, 4), top_cols)
    st_cols = ["label_id", "support", "accuracy"]
    assert grouped(M.top_n(M.label_stats(df, by=by), 5, group=by), ["dataset", *st_cols]) == \
        per_group(lambda x: M.top_n(M.label_stats(x), 5), st_cols)
    f1_cols = ["f1_macro", "n_labels"]
    assert grouped(M.macro_f1(df, by=by), ["dataset", *f1_cols]) == \
        per_group(lambda x: M.macro_f1(x), f1_cols)
    acc_cols = ["n_total", "n_correct", "accuracy"]
    assert grouped(M.overall_accuracy(df, by=by), ["dataset", *acc_cols]) == \
        per_group(lambda x: M.overall_accuracy(x), acc_cols)


def test_topk_null_label_ranks_last(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [(1, 1)] * 2 + [(2, 2)], "gold int, pred_label int")
    top = [(r.label, r.rank) for r in M.topk_labels(df, 2).collect()]
    assert top == [(1, 0), (2, 1)]
    conf = {(r.gold, r.pred): r.n for r in S.confusion_topk(df, 2).collect()}
    assert conf == {(1, 1): 2, (1, 2): 0, (2, 1): 0, (2, 2): 1}


def test_shuffle_partition_sizing():
    from driftlens.session import PARTITION_BYTES, shuffle_partitions_for
    assert shuffle_partitions_for(0) == 200
    assert shuffle_partitions_for(5 * 2 ** 40) == 5 * 2 ** 40 // PARTITION_BYTES
    assert shuffle_partitions_for(PARTITION_BYTES * 1000 + 1) == 1001


@pytest.mark.parametrize("name", ["wide", "groups", "dense", "hist"])
def test_reports_fail_on_a_dataset_outside_the_list(spark, name):
    df = spark.createDataFrame([(1, "indomain", 0.5), (2, "ood_c", 0.6)], "pred_label int, dataset string, pred_confidence double")
    dist = S.label_distribution(df, sort=False)
    report = {"wide": lambda: S.wide_distribution(dist, DATASETS), "groups": lambda: S.label_groups(dist, DATASETS),
              "dense": lambda: S.dense_counts(df, 3, DATASETS), "hist": lambda: S.confidence_histogram(df, DATASETS)}[name]
    with pytest.raises(Exception, match="dataset outside.*ood_c"):
        report().collect()


def test_histogram_with_shared_edges(spark):
    df = spark.createDataFrame([("indomain", 0.0), ("indomain", 0.4), ("ood_a", 1.0)], "dataset string, pred_confidence double")
    got = {(r.dataset, r.bin): r for r in S.confidence_histogram(df, DATASETS, bins=2, shared_edges=True).collect()}
    assert {(r.bin_lo, r.bin_hi) for r in got.values()} == {(0.0, 0.5), (0.5, 1.0)}
    assert [got[k].n for k in sorted(got)] == [2, 0, 0, 1]
