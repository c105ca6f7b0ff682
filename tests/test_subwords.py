"""Subword windows against the tokenizer library's longest match and a plain version."""

import random

import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from driftlens.operators import subwords as S
from driftlens.operators import tokens as TK

TEXTS = [None, "", " \n", "unaffable", "The UNAFFABLE fox, it's 42!", "x" * 101, "x" * 100, "zq", "é tard", "日本 語", "un" * 300,
         "fox " * 200, "able able un-able", " fox un", "##un [CLS] [PAD]"]
PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "the", "fox", "x", "a", "é", "4", ",", "!", "'", "it", "s", "[", "]", "cls", "-",
          "##un", "##aff", "##able", "##x", "##xx", "##2", "##a", "##b", "able", "tard", "#", "日", "##本"]


@pytest.fixture()
def vocabulary(spark, tmp_dir):
    with open(f"{tmp_dir}/vocab.txt", "w") as f:
        f.write("\n".join(PIECES) + "\n")
    return S.read_vocabulary(spark, f"{tmp_dir}/vocab.txt")


def rows_of(df):
    return {r.row_id: r for r in df.collect()}


def test_windows_equal_the_library(spark, vocabulary):
    ids = {p: i for i, p in enumerate(PIECES)}
    library = Tokenizer(models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=100))
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "row_id long, text string, mask int").repartition(3)
    got = S.subword_windows(df, vocabulary, length=16)
    assert got.columns == ["row_id", "text", "ids", "mask", "n_subwords", "n_unknown", "n_kept", "truncated"]
    for r in got.collect():
        words = regex.findall(S.WORDS, (r.text or "").lower())
        want, lost = [], 0
        for w in words:
            # a word of the text is never a mark of the vocabulary
            cut = [] if w in S.SPECIAL else [t.id for t in library.model.tokenize(w)]
            lost += cut == [1]
            want += cut
        assert (r.n_subwords, r.n_unknown, r.truncated) == (len(want), lost, len(want) > 14), r.text
        kept = [2, *want[:14], 3]
        assert r.n_kept == len(kept)
        assert r.ids == kept + [0] * (16 - len(kept))
        assert r["mask"] == [1] * len(kept) + [0] * (16 - len(kept))


def test_random_words_equal_a_plain_longest_match(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 6))) for _ in range(40)})
    voc = S.vocabulary_of(spark.createDataFrame([(w,) for w in words], "word string"))
    first, rest = S.load_vocabulary(voc)
    assert set(rest) == set(words) | set("".join(words)) and set(first) == set(rest) | set(S.SPECIAL)
    assert sorted([*first.values(), *rest.values()]) == list(range(len(first) + len(rest)))
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = rows_of(S.spelled(S.subword_windows(df, voc, length=30), voc))
    for i, t in enumerate(texts):
        pieces = []
        for w in t.split():
            out, left = [], w
            while left:
                hit = max((p for p in rest if left.startswith(p)), key=len, default=None)
                if hit is None:
                    out = ["[UNK]"]
                    break
                out.append(("##" if out else "") + hit)
                left = left[len(hit):]
            pieces += out
        window = ["[CLS]", *pieces[:28], "[SEP]"]
        assert got[i].pieces == window + ["[PAD]"] * (30 - len(window))
        assert got[i].n_subwords == len(pieces)


def test_report(spark, vocabulary):
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)], "row_id long, text string, dataset string")
    windows = S.subword_windows(df, vocabulary, length=10, keep=["dataset"])
    rows = windows.collect()
    for r in S.subword_report(windows).collect():
        own = [x for x in rows if x.dataset == r.dataset]
        assert (r.n_rows, r.n_truncated, r.subwords_total, r.subwords_kept, r.n_unknown) == (
            len(own), sum(x.truncated for x in own), sum(x.n_subwords for x in own),
            sum(min(x.n_subwords, 8) for x in own), sum(x.n_unknown for x in own))


def test_refused_vocabularies(spark):
    def voc(*rows):
        return spark.createDataFrame(list(rows), "piece string, first boolean, id int")

    marks = [(m, True, i) for i, m in enumerate(S.SPECIAL)]
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="lacks"):
        S.subword_windows(df, voc(*marks[1:]))
    with pytest.raises(ValueError, match="two ids"):
        S.subword_windows(df, voc(*marks, ("a", True, 5), ("a", True, 6)))
    with pytest.raises(ValueError, match="more than 3"):
        S.load_vocabulary(voc(*marks), 3)
    with pytest.raises(ValueError, match="two marks"):
        S.subword_windows(df, voc(*marks), length=1)
    with pytest.raises(ValueError, match="gap"):
        S.spelled(df, voc(*marks, ("a", True, 9)))
    assert S.subword_windows(df.limit(0), voc(*marks)).count() == 0
    clash = S.subword_windows(df.selectExpr("*", "'kept' AS __words"), voc(*marks)).first()
    assert clash["__words"] == "kept" and clash.n_unknown == 1


def test_words_agree_with_the_word_windows(spark):
    """Without marks and punctuation both window operators see the same words."""
    df = spark.createDataFrame([(i, (t or "").replace("[", "")) for i, t in enumerate(TEXTS)], "row_id long, text string")
    n = {r.row_id: r.n_tokens for r in TK.token_windows(df).collect()}
    found = df.select("row_id", F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(S.WORDS), F.lit(0)),
                                                lambda w: w.rlike(r"^[\p{L}\p{N}]+$"))).alias("n")).collect()
    assert {r.row_id: r.n for r in found} == n
