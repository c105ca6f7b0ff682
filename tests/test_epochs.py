"""Training in epochs against a plain numpy loop over dicts."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import epochs as E
from driftlens.plans import views
from tests.conftest import SF_SMALL


def h60(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain(rows, dims, epochs=3, batch=16, rate=0.5, seed=42, shards=8, normal=True, val=()):
    """rows: (id, label, indices, values). Returns weights and the history."""
    labels = sorted({r[1] for r in rows})
    vec = {}
    for i, _, idx, v in [*rows, *val]:
        x = np.zeros(dims)
        for k, z in zip(idx, v):
            x[k] += z
        if normal and x.any():
            x /= math.sqrt((x * x).sum())
        vec[i] = np.append(x, 1.0)
    w, history = np.zeros((len(labels), dims + 1)), []

    def price(w, x):
        z = w @ x
        e = np.exp(z - z.max())
        return z, e / e.sum()

    for e in range(1, epochs + 1):
        total, loss, right, steps = np.zeros_like(w), 0.0, 0, 0
        for s in range(shards):
            own = sorted((r for r in rows if h60(seed, "shard", r[0]) % shards == s), key=lambda r: (h60(seed, e, r[0]), r[0]))
            mine = w.copy()
            for a in range(0, len(own), batch):
                part, grad = own[a:a + batch], np.zeros_like(w)
                steps += 1
                for i, y, _, _ in part:
                    z, p = price(mine, vec[i])
                    c = labels.index(y)
                    loss -= math.log(p[c])
                    right += z.argmax() == c
                    p = p.copy()
                    p[c] -= 1
                    grad += np.outer(p, vec[i])
                mine -= rate * grad / len(part)
            total += mine * len(own)
        w = total / len(rows)
        entry = {"epoch": e, "n_rows": len(rows), "n_batches": steps, "loss": loss / len(rows), "accuracy": right / len(rows)}
        if val:
            priced = [(price(w, vec[i]), labels.index(y)) for i, y, _, _ in val]
            entry |= {"val_rows": len(val), "val_loss": sum(-math.log(p[c]) for (_, p), c in priced) / len(val),
                      "val_accuracy": sum(z.argmax() == c for (z, _), c in priced) / len(val)}
        history.append(entry)
    return w.T, history


def collected(df):
    return [(r.row_id, r.gold, r.features.indices, r.features["values"]) for r in df.collect()]


def same_history(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        assert all(g[k] == pytest.approx(w[k], abs=1e-9) for k in w)


@pytest.mark.parametrize("shards", [1, 5])
def test_texts_equal_a_plain_run(spark, shards):
    texts = E.hashed_features(views.texts(spark, SF_SMALL).filter("gold is not null"), dims=256)
    train, val = texts.filter("dataset = 'indomain'"), texts.filter("dataset <> 'indomain'")
    known = {r.gold for r in train.select("gold").distinct().collect()}
    val = val.filter(F.col("gold").isin(sorted(known)))
    m = E.fit_epochs(train.repartition(3), 256, shards=shards, validation=val)
    w, history = plain(collected(train), 256, shards=shards, val=collected(val))
    assert np.abs(m.weights - w).max() < 1e-9
    same_history(m.history, history)
    assert len(m.paths) == 3 and all(m.paths)
    assert m.history[-1]["loss"] < m.history[0]["loss"]
    scored = E.score_epochs(m, val.drop("text")).collect()
    assert np.mean([r.gold == r.pred_label for r in scored]) == pytest.approx(m.history[-1]["val_accuracy"])


def test_dense_vectors_equal_a_plain_run(spark):
    emb = E.dense_features(views.scored_vectors(spark, SF_SMALL), "embedding")
    train, val = emb.filter("dataset = 'indomain'"), emb.filter("dataset <> 'indomain'")
    m = E.fit_epochs(train, 64, shards=4, batch=7, rate=2.0, normal=False, validation=val)
    w, history = plain(collected(train), 64, shards=4, batch=7, rate=2.0, normal=False, val=collected(val))
    assert np.abs(m.weights - w).max() < 1e-9
    same_history(m.history, history)


def test_partitions_do_not_change_the_result(spark):
    emb = E.dense_features(views.scored_vectors(spark, SF_SMALL), "embedding")
    a, b = (E.fit_epochs(emb.repartition(n), 64, epochs=2) for n in (1, 9))
    assert np.abs(a.weights - b.weights).max() < 1e-12


def test_odd_rows(spark):
    rows = [(1, "a", [0.0, 1.0]), (2, "b", [1.0, 0.0]), (3, None, [1.0, 1.0]), (4, "a", None), (5, "b", [])] * 1
    df = E.dense_features(spark.createDataFrame(rows, "row_id long, gold string, v array<double>"), "v")
    m = E.fit_epochs(df, 2, shards=2, epochs=2, validation=df)
    assert m.labels == ["a", "b"] and m.history[-1]["n_rows"] == 4 and m.history[-1]["val_rows"] == 5
    got = {r.row_id: r.pred_label for r in E.score_epochs(m, df).collect()}
    assert got[1] == "a" and got[2] == "b" and len(got) == 5
    with pytest.raises(ValueError, match="no row has a label"):
        E.fit_epochs(df.filter("gold is null"), 2)
    with pytest.raises(ValueError, match="weights"):
        E.fit_epochs(df, E.MAX_WEIGHTS)


def test_training_plan_is_the_order_read(spark):
    got = E.training_plan(spark.range(100).withColumnRenamed("id", "row_id"), epochs=2, batch=4, shards=3).collect()
    for e in (1, 2):
        for s in range(3):
            mine = sorted((r.place, r.id, r.batch) for r in got if (r.epoch, r.shard) == (e, s))
            want = sorted((i for i in range(100) if h60(42, "shard", i) % 3 == s), key=lambda i: h60(42, e, i))
            assert [(i, b) for _, i, b in mine] == [(i, k // 4) for k, i in enumerate(want)]
