"""The bit filter before a join: nothing with a partner is lost, most of the rest goes."""

import json

import pytest
from pyspark.sql import functions as F

from driftlens.operators import naive_bayes as NB
from driftlens.operators import nb_long as NL
from driftlens.operators import prefilter as PF
from driftlens.plans import views
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("n", [0, 1, 5000, 60_000])
def test_no_partner_is_lost(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("token"))
    f = PF.key_bits(keys, "token", n)
    rows = spark.range(120_000).select(F.concat(F.lit("k"), F.col("id")).alias("token"), "id").unionAll(
        spark.createDataFrame([(None, -1)], "token string, id long"))
    got = {r.id for r in PF.may_match(rows, "token", f).select("id").collect()}
    assert set(range(n)) <= got and -1 not in got
    extra = len(got) - n
    assert extra <= 0.09 * (120_000 - n)
    if n == 60_000:
        assert extra > 0      # it is a filter, not the join


def test_too_many_keys_have_no_filter(spark):
    assert PF.key_bits(spark.range(1), "id", 10**9, max_bytes=1 << 20) is None


def shuffled_rows(df) -> int:
    """Rows that the sort-merge joins of the executed plan read."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name == "SortMergeJoinExec":
            left = p.left()
            while left.getClass().getSimpleName() != "ShuffleExchangeExec":
                left = left.plan() if "QueryStage" in left.getClass().getSimpleName() else left.children().apply(0)
            total += left.metrics().apply("shuffleRecordsWritten").value()
        if "QueryStage" in name:
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_unknown_words_do_not_shuffle(spark, monkeypatch):
    """The tail of scoring above the broadcast bound: equal scores with fewer shuffled rows."""
    texts = views.texts(spark, SF_SMALL)
    model = NB.fit_nb(texts.filter("dataset = 'indomain'").limit(20))
    monkeypatch.setattr(NB, "MAX_BROADCAST_BYTES", 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        with_filter = NB.score_nb(model, texts)
        scores = {r.row_id: (r.pred_label, round(r.pred_confidence, 9)) for r in with_filter.collect()}
        few = shuffled_rows(with_filter)
        monkeypatch.setattr(NB, "key_bits", lambda *_: None)
        without = NB.score_nb(model, texts)
        assert {r.row_id: (r.pred_label, round(r.pred_confidence, 9)) for r in without.collect()} == scores
        many = shuffled_rows(without)
        assert 0 < few < 0.7 * many, json.dumps([few, many])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_long_model_scores_alike_without_the_filter(spark, monkeypatch):
    texts = views.texts(spark, SF_SMALL)
    model = NL.fit_nb_long(texts.filter("dataset = 'indomain'").limit(20))
    a = {r.row_id: (r.pred_label, round(r.pred_confidence, 9)) for r in NL.score_nb_long(model, texts, max_bytes=1).collect()}
    monkeypatch.setattr(NL, "key_bits", lambda *_: None)
    b = {r.row_id: (r.pred_label, round(r.pred_confidence, 9)) for r in NL.score_nb_long(model, texts, max_bytes=1).collect()}
    assert a == b and len(a) == texts.count()
