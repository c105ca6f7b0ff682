"""The corpus pipeline against a plain composition of brute-force stages."""

import numpy as np
import pytest

import corpus_pipeline as C
from driftlens.llm import pieces, toxicity
from driftlens.llm.queries import QUERIES, held_out
from driftlens.llm.scratch import materialise
from tests.conftest import SF_SMALL
from tests.llm.test_texts import ALNUM, LOWER, brute_components, brute_contamination, brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        out.append(materialise(f(spark, out[-1], SF_SMALL)))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_stages(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination",
                                       "SentencePiece encoding"]
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert stages[-1].columns == [*COLUMNS, "piece_ids", "n_pieces"]


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "toxic")
    m = toxicity.fit(stages[0], labels.where(~held_out()))
    from driftlens.llm import words as W
    import pyarrow as pa
    kept = []
    for i, t in texts(stages[0]):
        words = ALNUM.findall((t or "").translate(LOWER))
        h = W.split_words(*W.utf8(pa.array([t or ""])), "alnum")[3]
        assert len(h) == len(words)
        tf = np.array([(h == x).sum() for x in m.terms], float)
        w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * m.idf
        score = m.empty
        if w.any():
            cos = m.weights @ (w / np.sqrt((w * w).sum()))
            best = sorted(range(len(cos)), key=lambda j: (-round(cos[j], 12), j))[:toxicity.NEIGHBOURS]
            best = [j for j in best if cos[j] > 0]
            near = [1 / (1 - min(cos[j], 1) + toxicity._SPACE) for j in best]
            vote = (sum(n * m.labels[j] for n, j in zip(near, best)) + m.base) / (sum(near) + 1)
            score = float(np.interp(vote, m.votes, m.rates)) if best else m.empty
        if score < toxicity.THRESHOLD:
            kept.append(i)
    assert kept == [i for i, _ in texts(stages[1])]


def test_line_stage(stages):
    left = brute_lines(texts(stages[1]))
    assert texts(stages[2]) == [(i, left[i][0]) for i, _ in texts(stages[1])]
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_copy_stage(stages):
    comp = brute_components(texts(stages[2]))
    assert texts(stages[3]) == [(i, t) for i, t in texts(stages[2]) if comp[i][1] == i]


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hit = brute_contamination(texts(stages[3]), items)
    assert texts(stages[4]) == [(i, t) for i, t in texts(stages[3]) if not hit[i][1]]


def test_encoding_stage(stages):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert texts(stages[5]) == texts(stages[4])
    for r in stages[5].collect():
        assert r.piece_ids == sp.encode(r.text) and r.n_pieces == len(r.piece_ids)


def test_stages_take_odd_rows(spark):
    """Null columns, empty tables and repeated texts go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5),
                                 (4, "a b c", None, "s", 5), (5, "x " * 50_000, "en", None, None)], schema)
    for df, want in ((odd, [1, 2, 3, 5]), (odd.limit(0), [])):
        for _, f in C.STAGES:
            df = materialise(f(spark, df, SF_SMALL))
        assert sorted(r.doc_id for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_whole_table(spark, name):
    table = {"op1": "embeddings", "op12": "embeddings", "op7": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    key = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    got = QUERIES[name](spark, SF_SMALL).select(key).collect()
    want = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").select(key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
