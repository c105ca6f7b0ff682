"""Wavelet matrices and token files against plain arrays and the tokenizer library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftlens.checks import ColumnContractError
from driftlens.llm import queries, token_files as T
from driftlens.llm import words as W
from driftlens.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_tokenizer())


@pytest.mark.parametrize("n,top,digits", [(0, 5, 3), (1, 2, 1), (511, 9, 4), (512, 9, 4), (513, 70_000, 17),
                                          (5000, 3, 2), (20_000, 49_000, 16), (4096, 1, 16), (1024, 2, 1)])
def test_wavelet_matrix(n, top, digits):
    rng = np.random.default_rng(n + top)
    x = rng.integers(0, top, n).astype(np.uint32)
    sizes = np.array([n // 3, 0, n - n // 3])
    m, ids, got = from_bytes(to_bytes(WaveletMatrix.of(x, digits), [None, 5, -7], sizes))
    assert ids == [None, 5, -7] and got.tolist() == sizes.tolist()
    assert (m.ids() == x).all()
    at = rng.integers(0, max(n, 1), min(n, 300))
    assert (m.access(at) == x[at]).all()
    for t in {int(v) for v in x[:8]} | {0, 1, 2**digits - 1, 2**digits + 1}:
        assert m.occurrences(t).tolist() == np.flatnonzero(x == t).tolist()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count([t], a, b)[0] == (x[a:b] == t).sum()


def test_damaged_shard_is_refused():
    good = to_bytes(WaveletMatrix.of(np.arange(9, dtype=np.uint16), 4), [1], np.array([9]))
    with pytest.raises(ValueError):
        from_bytes(b"none" + good[4:])
    with pytest.raises(ValueError):
        from_bytes(to_bytes(WaveletMatrix.of(np.arange(9, dtype=np.uint16), 4), [1], np.array([8])))


def equal_to_library(enc, library, texts):
    at, ids = enc.encode(*W.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_units_are_encoded_as_the_library_does(library, monkeypatch):
    monkeypatch.setattr(T, "KEPT_UNITS", 256)  # forget and grow often
    enc, rng = T.UnitEncoder(T.default_tokenizer()), random.Random(7)
    parts = [*"abzSTRE'\"().,-_<|>019 \t\n\r\x0b\x85\xa0é́ñÉ日本 İßΣς😀\x00\x7f~`ÿ÷×", "'s", "'LL", "'ve", "n't",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "hello", "Été", "  ", "don't", "́"]
    for _ in range(1500):
        equal_to_library(enc, library, ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(5)])
    many = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(5000)]
    equal_to_library(enc, library, [" ".join(many), "x" * 20_000, "é" * 3000 + ",", "1" * 500])


def pairs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def expected(library, texts):
    """(doc_id, ids) in the order of the files: by id, null first."""
    rows = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("shard", [1, 40, 1 << 22])
def test_files_answer_like_plain_arrays(spark, tmp_dir, library, shard):
    rng = random.Random(shard)
    words = ["the", "Cat", "sat", "élan", "12", "on", "a,b", "mat."]
    texts = [(i * 7 % 101 - 50, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(100)]
    texts += [(200, None), (201, ""), (202, "the " * 500), (None, "null id")]
    files = T.write(pairs(spark, texts).repartition(5), f"{tmp_dir}/tokens", shard_tokens=shard).cache()
    rows = expected(library, texts)
    flat = [t for _, x in rows for t in x]
    got = sorted(T.documents(files).collect(), key=lambda r: r.start)
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == rows
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for _, x in rows])[:-1].tolist()
    assert [r.n_tokens for r in got] == [len(x) for _, x in rows]
    sizes = [r.n_tokens for r in files.orderBy("start").collect()]
    assert sum(sizes) == len(flat) and (shard > 1 or len(sizes) == len(rows))
    tokens = sorted({*rng.sample(flat, 5), 1, 49_000})
    want = [(t, flat.count(t)) for t in tokens]
    assert sorted(map(tuple, T.counts(files, tokens + tokens).collect())) == want
    found = [(t, i, at, start + at) for t in tokens for (i, x), start in zip(rows, (r.start for r in got))
             for at, y in enumerate(x) if y == t]
    key = lambda r: (r[0], r[3])
    assert sorted(map(tuple, T.occurrences(files, tokens).collect()), key=key) == sorted(found, key=key)
    places = [0, 5, len(flat) - 1, len(flat), 10**9, len(flat) // 2]
    assert sorted(map(tuple, T.tokens_at(files, places).collect())) == [(p, flat[p]) for p in sorted(places) if p < len(flat)]


def test_repeated_ids_are_written_once_each(spark, tmp_dir, library):
    texts = [(5, "one two")] * 40 + [(5, "three"), (4, "four"), (6, "six")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = T.write(pairs(spark, texts).repartition(4), f"{tmp_dir}/t", shard_tokens=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = T.documents(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted(expected(library, texts))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert files.select("part").distinct().count() > 1  # one id does not go to one task


def test_empty_table_and_clashing_columns(spark, tmp_dir):
    df = pairs(spark, [(1, "a b")]).selectExpr("*", "1 AS ids", "2 AS h", "3 AS row", "4 AS before", "5 AS part")
    assert T.documents(T.write(df, f"{tmp_dir}/a")).first().n_tokens == 3
    none = T.write(df.limit(0), f"{tmp_dir}/b")
    assert T.documents(none).count() == 0 and T.counts(none, [1]).count() == 0
    assert T.documents(T.write(df, f"{tmp_dir}/c", end_id=None)).first().n_tokens == 2
    # an id beyond the vocabulary only widens the planes
    wide = T.documents(T.write(df, f"{tmp_dir}/d", end_id=70_000)).first()
    assert np.frombuffer(wide.ids, "<u4").tolist()[-1] == 70_000
    with pytest.raises(ColumnContractError):
        T.write(df.select("text"), f"{tmp_dir}/e")


def test_query_meets_its_contract(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = queries.op13_token_files(spark, SF_SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {t for _, t in got.dtypes} == {"bigint"}
    want, start = [], 0
    for i, ids in expected(library, docs):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect())) == want
