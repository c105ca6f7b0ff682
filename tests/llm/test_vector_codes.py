"""Vector codes against plain integer k-means."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from driftlens.checks import ColumnContractError
from driftlens.llm import queries, vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, code, error, label)] and the codebooks, by comparing every point with every entry."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    seeds = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        seeds.setdefault(i, v)
    seeds = [seeds[i] for i in sorted(seeds)][:entries]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for _, v, _ in kept] for p in range(parts)]
    books = [[s[p * w:(p + 1) * w] for s in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(x, books[p])[1] for x in cut[p]]
            for e in set(own):
                mine = [x for x, o in zip(cut[p], own) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for k, (i, _, label) in enumerate(kept):
        got = [near(cut[p][k], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
    return out, books


def check(spark, rows, schema=SCHEMA, **kw):
    got, books = V.compress(spark.createDataFrame(rows, schema).repartition(3), **kw)
    want, brute_books = brute(rows, **kw)
    assert books.tolist() == brute_books
    key = repr
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got.collect()), key=key) == sorted(want, key=key)
    return got, books


@pytest.mark.parametrize("bits,dims", [(1, 3), (2, 2), (3, 2), (2, 3), (1, 8), (4, 1)])
def test_hilbert_curve_steps_to_a_neighbour(bits, dims):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = V.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_hilbert_key_of_wide_values():
    x = np.random.default_rng(2).integers(0, 128, (5000, 8))
    key = V.hilbert_key(x, 7)
    assert (key >= 0).all() and len(np.unique(key)) == len(np.unique(x, axis=0)) and (key < 1 << 56).all()


def test_short_lists_keep_every_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(200):
        book = rng.integers(-6, 7, (rng.integers(1, 9), 3))
        x = rng.integers(-6, 7, 3) + rng.integers(0, 3, (20, 3))
        listed = V.short_lists(x.min(0)[None], x.max(0)[None], book)[0]
        d = np.square(x[:, None] - book[None]).sum(2)
        assert listed[(d == d.min(1, keepdims=True)).any(0)].all()
        e, far = V.nearest(x, book, np.flatnonzero(listed))
        assert (e == d.argmin(1)).all() and (far == d.min(1)).all()


def test_random_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_POINTS", 8)
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 0.2, (6, 16))
    rows = [(i * 3, (centre[i % 6] + rng.normal(0, 0.02 * (i % 3), 16)).astype(np.float32).tolist(), i % 4) for i in range(300)]
    check(spark, rows)
    check(spark, rows, parts=4, entries=5, rounds=3)
    check(spark, [(i, v, None) for i, v, _ in rows], parts=16, entries=40, rounds=2)


def test_ties_copies_and_unused_entries(spark):
    # equal seeds: the later ones are never used and stay; a third of all rows is one vector
    grid = [[float(b) / 64 for b in np.unravel_index(k, (2, 2, 2, 2))] * 2 for k in range(16)]
    rows = [(i, grid[0], 0) for i in range(8)] + [(i, grid[i % 16], i % 3) for i in range(8, 60)]
    rows += [(100 + i, grid[5], None) for i in range(40)] + [(30, grid[2], 1)] * 3 + [(None, grid[7], 2)]
    check(spark, rows)


def test_fewer_vectors_than_entries(spark):
    check(spark, [(7, [0.1, -0.2, 0.3, 0.4, -0.5, 0.6, -0.7, 0.8], 1)])
    check(spark, [(2, [1e-9, -1e-9] * 8, 1), (1, [-3.0, 3.0] * 8, None), (2, [0.0] * 16, 1)])


def test_dropped_rows_and_empty_tables(spark):
    good = [(i, [math.sin(i * 7 + j) for j in range(8)], i % 2) for i in range(30)]
    bad = [(50, None, 1), (51, [], 1), (52, [None] * 8, 1), (53, [0.1] * 7 + [float("nan")], 0),
           (54, [float("inf")] + [0.0] * 7, 0), (-5, [0.1] * 7 + [None], 0)]
    got, _ = check(spark, good + bad)
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 30
    for rows in ([], bad):
        got, books = V.compress(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and V.codebook_text(books) == ""
        assert V.with_label_error(got).columns == ["vec_id", "label", "code", "error", "label_error"]


def test_refused_tables(spark):
    def run(rows, **kw):
        return V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **kw)

    with pytest.raises(ValueError, match="equal and a multiple"):
        run([(1, [0.1] * 8, 0), (2, [0.1] * 16, 0)])
    with pytest.raises(ValueError, match="equal and a multiple"):
        run([(1, [0.1] * 9, 0)])
    with pytest.raises(ValueError, match="exact distances"):
        run([(1, [5e5] * 8, 0), (2, [-5e5] * 8, 0)])
    with pytest.raises(Exception, match="(?i)overflow"):
        run([(1, [1e30] * 8, 0)])
    with pytest.raises(ValueError, match="no vector has an id"):
        run([(None, [0.1] * 8, 0)])
    with pytest.raises(ColumnContractError):
        V.compress(spark.createDataFrame([(1,)], "vec_id long"))


def test_extra_columns_are_ignored(spark):
    rows = [(i, [float(i + j) for j in range(8)], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    names = ("row", "ints", "code", "error", "part", "key", "point")
    a = V.compress(df.withColumns({c: df.embedding for c in names}))
    b = V.compress(df)
    assert sorted(a.rows.collect()) == sorted(b.rows.collect()) and (a.codebooks == b.codebooks).all()


def test_label_error(spark):
    codes = spark.createDataFrame([(1, "a", "00", 5), (2, "a", "00", 6), (3, None, "00", 7), (4, None, "01", 8)],
                                  "vec_id long, label string, code string, error long")
    got = {r.vec_id: r.label_error for r in V.with_label_error(codes).collect()}
    assert got == {1: 11, 2: 11, 3: 15, 4: 15}


def test_restored_vectors(spark):
    rows = [(i, [float(i + j) / 64 for j in range(16)], 0) for i in range(40)]
    codes, books = V.compress(spark.createDataFrame(rows, SCHEMA))
    back = {r.vec_id: (r.restored, r.error) for r in V.restore(codes, books).collect()}
    for i, v, _ in rows:
        x, error = back[i]
        assert sum((4096 * a - 4096 * b) ** 2 for a, b in zip(x, v)) == error
    null = spark.createDataFrame([(None,)], "code string")
    assert V.restore(null, books).first().restored is None


def test_query(spark, tmp_dir):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.1, 64).astype(np.float32).tolist(), i % 5 or None) for i in range(200)] + [(500, None, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_dir}/embeddings.parquet")
    got = queries.op12_vector_codes(spark, tmp_dir)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, books = brute(rows)
    text = ",".join(str(x) for b in books for e in b for x in e)
    total = {}
    for _, _, error, label in want:
        total[label] = total.get(label, 0) + error
    assert sorted(map(tuple, got.collect())) == sorted(
        (i, c, e, total[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in want)
