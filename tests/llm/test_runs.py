"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from driftlens.llm import queries, runs
from driftlens.checks import ColumnContractError
from tests.conftest import SF_SMALL

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(x, least=12):
    """(start, end, period) of every run of the list ``x``, by start and period."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, least=12):
    found = brute_runs(words, least)
    drop = {i for s, e, q in found for i in range(s + q, e)}
    return [(s, e - s, q) for s, e, q in found], " ".join(w for i, w in enumerate(words) if i not in drop)


def word_runs(docs, least=12):
    row = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
    name = np.array([v for d in docs for v in d], np.uint64)
    return list(zip(*[v.tolist() for v in runs.word_runs(row, name, least)]))


def test_every_short_binary_text():
    for n in range(1, 12):
        for v in range(1 << n):
            x = [v >> i & 1 for i in range(n)]
            assert word_runs([x], 1) == brute_runs(x, 1), x


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            n, letters = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
            x = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randrange(4)):
                if n > 3:
                    a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
                    for i in range(a + p, min(n, a + rng.randrange(1, 60))):
                        x[i] = x[i - p]
            docs.append(x)
        least, want, at = rng.choice([1, 2, 4, 12]), [], 0
        for d in docs:
            want += [(s + at, e + at, q) for s, e, q in brute_runs(d, least)]
            at += len(d)
        assert word_runs(docs, least) == want


def test_words_known_for_many_runs():
    fib, thue = ["a", "ab"], "a"
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
        thue += thue.translate(str.maketrans("ab", "ba")) if len(thue) < 128 else ""
    stair = "".join("ab" * k + "c" for k in range(1, 12))
    crossing = "ab" * 5 + "a" + "ab" * 5 + "a"
    for t in (fib[-1], thue, stair, crossing, crossing * 3, "a" * 200, "aab" * 30 + "aabaa" * 12):
        x = [ord(c) for c in t]
        assert word_runs([x], 2) == brute_runs(x, 2)
        assert word_runs([x, x[::-1]], 12) == brute_runs(x) + [
            (s + len(x), e + len(x), q) for s, e, q in brute_runs(x[::-1])]


def test_long_text_in_bounded_levels():
    x = np.random.default_rng(5).integers(0, 4000, 200_000).astype(np.uint64)
    x[150_000:190_000] = np.resize(x[150_000:150_777], 40_000)
    x[50_000:50_024] = 9
    got = list(zip(*[v.tolist() for v in runs.word_runs(np.zeros(len(x), np.int64), x)]))
    assert len(got) == 2
    (a, b, q), (c, d, r) = got
    assert a <= 50_000 and b >= 50_024 and q == 1 and c <= 150_000 and d >= 190_000 and r == 777


def test_collapse_on_odd_rows(spark):
    texts = [None, "", " \t\n ", "one", "x " * 40, "a b\tc\x0bd " * 6, "é ñ 日本 " * 5 + "end", "x y " * 13,
             "p q r s t u v w x y z", "A a A a A a A a A a A a", "w" * 10_000 + " k" * 3000]
    rows = [(i, t, "in") for i, t in enumerate(texts)] + [(None, "z " * 20, None), (4, texts[4], "in"), (4, texts[4], "in")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = runs.collapse(df)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]  # a column named runs is replaced
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        words = SOLID.findall(r.text or "")
        want, left = brute_collapse(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), want, left)
    assert runs.collapse(df.limit(0)).count() == 0
    kept = runs.collapse(df.withColumnRenamed("runs", "__text"), keep=["doc_id", "__text"])
    assert kept.columns == ["doc_id", "__text", "n_words", "runs", "collapsed"] and kept.count() == len(rows)
    with pytest.raises(ColumnContractError):
        runs.collapse(df.select("doc_id"))


def contract(doc_id, text):
    """The row that the contract of the query asks for, by plain Python."""
    words = SOLID.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found, left = brute_collapse(words)
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    text = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), start, length, period, 1000 * length // period if found else None,
            hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_query_meets_its_contract(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = queries.op11_periodic_runs(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert {c for _, c in got.drop("runs_sha256", "collapsed_sha256").dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(contract(*d) for d in docs)


def test_contract_on_odd_rows(spark, tmp_dir):
    odd = [(i, t) for i, t in enumerate([None, "", " \n", "a", "a b", "a b c", "b " * 30] * 12)] + [(None, "y " * 30)]
    (spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet"))
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, tmp_dir).collect()}
    want = {contract(*d) for d in odd[:-1]} | {(None, *contract(0, "y " * 30)[1:])}
    assert zlib.crc32(b"0") % 10 and got == want
