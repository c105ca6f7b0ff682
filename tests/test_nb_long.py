"""The sparse long Naive Bayes against a dense computation in numpy."""

import random
from collections import Counter

import numpy as np
import pytest
import regex

from driftlens.operators import naive_bayes as NB
from driftlens.operators import nb_long as NL
from driftlens.plans import views
from tests.conftest import SF_SMALL

WORDS = regex.compile(r"[\p{L}\p{N}]+")


def dense(train, docs, alpha=1.0):
    """{row_id: (label, confidence)}: every class scored for every document."""
    labels = sorted({g for _, g, _ in train if g is not None})
    at = {g: i for i, g in enumerate(labels)}
    n_docs, seen = Counter(), Counter()
    for _, g, t in train:
        if g is not None:
            n_docs[g] += 1
            for w in WORDS.findall((t or "").lower()):
                seen[w, g] += 1
    words = sorted({w for w, _ in seen})
    count = np.zeros((len(words), len(labels)))
    for (w, g), n in seen.items():
        count[words.index(w), at[g]] = n
    prior = np.log(np.array([n_docs[g] for g in labels]) / sum(n_docs.values()))
    lp = np.log((count + alpha) / (count.sum(0) + alpha * max(len(words), 1)))
    row = {w: lp[i] for i, w in enumerate(words)}
    out = {}
    for i, t in docs:
        s = prior + sum((row[w] for w in WORDS.findall((t or "").lower()) if w in row), np.zeros(len(labels)))
        best = np.flatnonzero(s >= s.max() - 1e-9)[0]
        out[i] = (labels[best], 1 / np.exp(s - s.max()).sum())
    return out


def corpus(seed, classes, rows, words=400):
    rng = random.Random(seed)
    text = lambda: " ".join(f"w{min(int(rng.expovariate(0.02)), words)}" for _ in range(rng.randrange(12)))
    train = [(i, f"c{rng.randrange(classes):05d}", text()) for i in range(rows)]
    train += [(rows + i, f"c{i:05d}", text()) for i in range(classes)] + [(-1, None, "w1 never"), (-2, "c00001", None)]
    docs = [(i, text()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "unknown words"), (1003, "w1 " * 600)]
    return train, docs


def scored(spark, train, docs, **kw):
    m = NL.fit_nb_long(spark.createDataFrame(train, "row_id long, gold string, text string").repartition(3))
    rows = NL.score_nb_long(m, spark.createDataFrame(docs, "row_id long, text string").repartition(3), **kw).collect()
    return {r.row_id: (r.pred_label, r.pred_confidence) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for i, (label, conf) in want.items():
        assert got[i][0] == label, (i, got[i], want[i])
        assert got[i][1] == pytest.approx(conf, abs=1e-9)


def test_thousands_of_classes(spark):
    train, docs = corpus(1, 3000, 3000)
    want = dense(train, docs)
    same(scored(spark, train, docs), want)
    same(scored(spark, train, docs, distinct_texts=True), want)


@pytest.mark.parametrize("max_bytes", [1, 6000, 25_000])
def test_models_beyond_the_broadcast_bound(spark, max_bytes):
    train, docs = corpus(2, 40, 500)
    m = NL.fit_nb_long(spark.createDataFrame(train, "row_id long, gold string, text string"))
    at = NL._hot_tokens(m, max_bytes)
    assert at is None if max_bytes == 1 else at > 0
    same(scored(spark, train, docs, max_bytes=max_bytes), dense(train, docs))


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_CLASSES": 150, "BLOCK_PAIRS": 700, "CHUNK_WORDS": 60, "BLOCK_COST": 10}])
def test_words_that_all_classes_saw_meet_texts_in_blocks(spark, monkeypatch, sizes):
    def joined(prices):
        raise AssertionError("a row for every (text, class)")

    monkeypatch.setattr(NL, "_best", joined)
    for name, size in sizes.items():
        monkeypatch.setattr(NL, name, size)
    rng = random.Random(4)
    text = lambda: " ".join(["all", "All", f"w{rng.randrange(3)}", f"x{rng.randrange(40)}"][rng.randrange(2):])
    train = [(i, f"c{i % 2000:05d}", text()) for i in range(5000)] + [(-1, "c00007", None), (-2, "d", ""), (-3, None, "never")]
    docs = [(i, text()) for i in range(60)] + [(60, None), (61, ""), (62, "unknown never"), (63, "all " * 300), (64, "w1 w1 x3 zz")]
    same(scored(spark, train, docs, distinct_texts=True), dense(train, docs))


def test_ties_go_to_the_smaller_label(spark):
    train = [(1, "b", "x y"), (2, "a", "x y"), (3, "c", "z")]
    got = scored(spark, train, [(1, "x"), (2, ""), (3, "z"), (4, "x z"), (5, "y y y")])
    assert [got[i][0] for i in (1, 2, 3, 5)] == ["a", "a", "c", "a"]
    same(got, dense(train, [(1, "x"), (2, ""), (3, "z"), (4, "x z"), (5, "y y y")]))


def test_classes_without_words_and_empty_models(spark):
    train = [(1, "a", None), (2, "b", ""), (3, "b", "!!")]
    docs = [(1, "x"), (2, None)]
    same(scored(spark, train, docs), dense(train, docs))
    got = scored(spark, [(1, None, "x y")], docs)
    assert got == {1: (None, None), 2: (None, None)}
    assert scored(spark, train, []) == {}


def test_ids_and_kept_columns(spark):
    m = NL.fit_nb_long(spark.createDataFrame([("a", "x"), ("b", "y")], "gold string, text string"))
    docs = spark.createDataFrame([(None, "x", "p"), (2, "y", None)], "row_id long, text string, class string")
    rows = NL.score_nb_long(m, docs, keep=("class", "text")).collect()
    assert sorted((r.row_id or 0, r["class"], r.text, r.pred_label) for r in rows) == [(0, "p", "x", "a"), (2, None, "y", "b")]
    twice = docs.unionAll(docs.where("row_id = 2"))
    with pytest.raises(Exception, match="share an id"):
        NL.score_nb_long(m, twice).collect()


def test_equal_to_the_wide_model(spark):
    texts = views.texts(spark, SF_SMALL)
    train = texts.where("dataset = 'indomain' and gold is not null and text is not null")
    wide = {r.row_id: (r.pred_label, r.pred_confidence) for r in NB.score_nb(NB.fit_nb(train), texts).collect()}
    same({r.row_id: (r.pred_label, r.pred_confidence)
          for r in NL.score_nb_long(NL.fit_nb_long(train), texts).collect()}, wide)


def test_save_and_load(spark, tmp_dir):
    train, docs = corpus(3, 10, 50)
    m = NL.fit_nb_long(spark.createDataFrame(train, "row_id long, gold string, text string"))
    NL.save_nb_long(m, f"{tmp_dir}/m")
    again = NL.load_nb_long(spark, f"{tmp_dir}/m")
    df = spark.createDataFrame(docs, "row_id long, text string")
    key = lambda r: r.row_id
    assert sorted(NL.score_nb_long(m, df).collect(), key=key) == sorted(NL.score_nb_long(again, df).collect(), key=key)
    pairs = {(r.token, r.label) for r in again.long_table().collect()}
    assert pairs == {(w, g) for _, g, t in train if g for w in WORDS.findall((t or "").lower())}
