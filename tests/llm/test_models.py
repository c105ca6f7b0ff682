"""Embeddings, toxicity, language, pieces, pages, licences, urls."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlens.llm import language, lattice, licenses, main_text, pieces, toxicity, url_rules
from driftlens.llm import words as W
from tests.conftest import SF_SMALL

# ---- embeddings


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    roots = []
    for i, j in combinations(range(8), 2):
        for a in (-2, 2):
            for b in (-2, 2):
                v = [0] * 8
                v[i], v[j] = a, b
                roots.append(v)
    roots += [[-1 if m >> i & 1 else 1 for i in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    roots = np.array(roots)
    assert len(roots) == 240
    x = rng.normal(size=(500, 8))
    own = lattice.decode(x)
    rest = x - own / 2
    around = ((rest[:, None] - roots / 2) ** 2).sum(axis=2)
    assert ((rest ** 2).sum(axis=1) <= around.min(axis=1) + 1e-12).all()
    assert np.allclose(((rest - lattice.step(rest) / 2) ** 2).sum(axis=1), around.min(axis=1))


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = rng.normal(size=64)
        for _ in range(12):
            rows.append((base / np.linalg.norm(base) + rng.normal(size=64) * rng.choice([0, 0.01, 0.03, 0.06])).tolist())
    rows += [rng.normal(size=64).tolist() for _ in range(60)]
    rows += [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None] + [0.0] * 62, [float("inf")] * 64]
    rows += [[2.0] * 5, [1.0] * 5, [-1.0] * 5, [1e30] * 64, [3.0] * 64, rows[0], rows[0]]
    return [(i * 3 % 1000, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None)
            for i, v in enumerate(rows)]


def brute_links(rows):
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    near = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} if i in unit
            else set() for i, _ in rows}
    comp = {i: i for i, _ in rows}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in near[i])]) for i in comp}
        if new == comp:
            return {i: (len(near[i]), comp[i], i == comp[i]) for i in comp}
        comp = new


@pytest.mark.parametrize("rows,kind", [(512, "float"), (7, "double")])
def test_near_vectors_equal_brute_force(spark, monkeypatch, rows, kind):
    monkeypatch.setattr(lattice, "BLOCK_ROWS", rows)
    data = vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], f"vec_id long, embedding array<{kind}>, n_links int, cell int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect()}
    assert got == brute_links(data)


def test_near_vectors_of_nothing(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    odd = spark.createDataFrame([(None, [1.0]), (1, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, lattice.near_vectors(odd).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


# ---- toxicity

def test_nearest_equals_brute_force():
    rng = np.random.default_rng(3)
    counts = (rng.random((700, 40)) < 0.06) * rng.integers(1, 4, (700, 40))
    counts[100:130] = counts[100]
    w = toxicity._unit(counts.astype(np.float32), np.ones(40))
    order, top = toxicity.index(w)
    w = w[order]
    q = np.concatenate([w[:50], toxicity._unit((rng.random((60, 40)) < 0.1).astype(float), np.ones(40)), np.zeros((1, 40))])
    pos, cos = toxicity.nearest(q, w, top, 9)
    dots = np.round(q @ w.T, 12)
    for i in range(len(q)):
        best = sorted(((-c, j) for j, c in enumerate(dots[i]) if c > 0))[:9]
        assert [j for j in pos[i] if j >= 0] == [j for _, j in best]
        assert np.allclose(cos[i, :len(best)], [-c for c, _ in best])


def test_isotonic_fit():
    x, y = np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 0, 1.0])
    xs, ys = toxicity.monotone(x, y)
    assert xs.tolist() == [0.1, 0.2, 0.3, 0.4] and np.allclose(ys, [0, 1 / 3, 1 / 3, 1])


def toxic_corpus():
    rng = random.Random(6)
    v = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(v) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for x in rng.sample(["vile", "rotten", "nasty", "horrid"], 2):
                w.insert(rng.randrange(len(w)), x)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_scores(spark):
    docs, labels = toxic_corpus()
    extra = [(1000, None), (1001, ""), (1002, "..."), (1003, "vile " * 60_000), (1004, "Vile, ROTTEN!"), (1004, "fine day")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs + extra], "doc_id long, text string, score string, toxic int")
    lab = spark.createDataFrame([(i, y, 1) for i, y in labels if i % 4] + [(2, None, 1), (None, 1, 1), (5, 1, 1), (9999, 1, 1)],
                                "doc_id long, toxic int, text int")
    model = toxicity.fit(df, lab)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {(r.doc_id, r.text): r for r in rows}
    assert sum(got[i, t].predicted == y for (i, t), (_, y) in zip(docs, labels) if i % 4 == 0) >= 98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for i, t in extra[:3]:
        assert got[i, t].score == model.empty and got[i, t].evidence_ids == []
    assert got[1003, "vile " * 60_000].predicted == 1 and got[1004, "Vile, ROTTEN!"].predicted == 1
    one = got[1004, "Vile, ROTTEN!"]
    assert one.evidence_cosines == sorted(one.evidence_cosines, reverse=True) and set(one.evidence_ids) <= set(range(400))


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame(toxic_corpus()[0][:5], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0] * 5
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []


def test_toxic_copies_do_not_hide_the_terms(spark):
    """Copies of one toxic text are 40 percent of the labels."""
    docs, labels = toxic_corpus()
    docs = [(i, t + "".join(" u%dx%d" % (i, j) for j in range(60))) for i, t in docs]
    copies = [(2000 + i, "vile rotten " + " ".join("w%d" % j for j in range(20))) for i in range(200)]
    df = spark.createDataFrame(docs + copies, "doc_id long, text string")
    lab = [(i, y) for i, y in labels if i % 4] + [(i, 1) for i, _ in copies]
    assert sum(y for _, y in lab) / len(lab) > 0.5 and len(copies) / len(lab) == 0.4
    model = toxicity.fit(df, spark.createDataFrame(lab, "doc_id long, toxic int"))
    words = W.split_words(*W.utf8(pa.array(["vile rotten nasty horrid"])), "alnum")[3]
    assert set(words) <= set(model.terms)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] == y for (i, _), (_, y) in zip(docs, labels) if i % 4 == 0) >= 98


def test_witnesses_are_near_copies_only(spark):
    """Long texts over the same words are as many witnesses as texts; edited copies are one."""
    rng = random.Random(13)
    v = ["w%d" % i for i in range(200)]
    own = [" ".join(rng.choice(v) for _ in range(600)) for _ in range(60)]
    copy = own[0].split()
    edits = [" ".join(copy[:k] + ["x%d" % k] + copy[k + 1:]) for k in range(0, 600, 20)]
    docs = list(enumerate(own + edits))
    df = spark.createDataFrame([(i, i % 2, t) for i, t in docs], "doc_id long, toxic int, text string")
    rows = df.mapInArrow(toxicity._example_terms, "doc_id long, toxic int, terms binary, tf binary, sig binary").orderBy("doc_id").collect()
    kin = toxicity.witnesses(np.frombuffer(b"".join(bytes(r.sig) for r in rows), np.uint16).reshape(len(rows), -1))
    assert kin.tolist() == [*range(60), *[0] * 30]


def test_long_toxic_texts_keep_their_terms(spark):
    rng = random.Random(14)
    v = ["w%d" % i for i in range(200)]
    docs, labels = [], []
    for i in range(200):
        w = [rng.choice(v) for _ in range(800)]
        if i % 5 == 0:
            w[rng.randrange(800)] = "vile"
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, toxic int"))
    assert model.terms.tolist() == W.split_words(*W.utf8(pa.array(["vile"])), "alnum")[3].tolist()
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert got == dict(labels)


# ---- language

def test_prices_equal_a_plain_tree():
    texts = {"aa": ["abracadabra", "abra"], "bb": ["banana bandana", "Nab"]}
    langs = sorted(texts)
    tree = {}
    for x in langs:
        for t in texts[x]:
            s = b" " * language.ORDER + t.lower().encode()
            for i in range(language.ORDER, len(s)):
                for k in range(language.ORDER + 1):
                    tree.setdefault((x, s[i - k:i]), Counter())[s[i]] += 1

    def bits(x, context, byte):
        c = tree.get((x, context))
        if c is None:
            return bits(x, context[1:], byte) if context else 8.0
        if byte in c:
            return -np.log2(c[byte] / (c.total() + len(c)))
        escape = -np.log2(len(c) / (c.total() + len(c)))
        return escape + (bits(x, context[1:], byte) if context else 8.0)

    lang, gram = [], []
    for i, x in enumerate(langs):
        _, g = language.grams(*W.utf8(pa.array(texts[x])))
        gram.append(g)
        lang.append(np.full(len(g), i))
    gram, lang = np.concatenate(gram), np.concatenate(lang)
    model = language.Model(language.price(langs, lang, gram, np.ones(len(gram), np.int64)))
    probe = ["bandana abra", "xyzzy", "a", "", "NaNa é"]
    got = model.lengths(*W.utf8(pa.array(probe)))
    for r, t in enumerate(probe):
        s = b" " * language.ORDER + t.lower().encode()
        for i, x in enumerate(langs):
            want = sum(bits(x, s[k - language.ORDER:k], s[k]) for k in range(language.ORDER, len(s)))
            assert got[r, i] == pytest.approx(want, rel=1e-5)


def test_three_hundred_languages(spark):
    """Languages of one syllable set each: the model's tables have 4 bytes per gram and language."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = [["".join(rng.choices(letters, k=2)) for _ in range(12)] for _ in range(300)]
    word = lambda i: "".join(rng.choices(sets[i], k=3))
    rows = [(i, " ".join(word(i % 300) for _ in range(12)), f"l{i % 300:03d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id < 1200"), per_language=4)
    assert len(model["languages"]) == 300
    size = sum(p.nbytes + e.nbytes for _, p, _, e in model["orders"])
    assert all(p.dtype == np.float32 for _, p, _, _ in model["orders"])
    assert size == sum(4 * 300 * (len(k) + len(c)) for k, _, c, _ in model["orders"]) < language.MODEL_BYTES
    got = language.predict(df.where("doc_id >= 1200"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_models_too_large_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(f"text {i} of it", f"l{i}") for i in range(40)], "text string, lang string")
    monkeypatch.setattr(language, "MAX_LANGUAGES", 39)
    with pytest.raises(ValueError, match="more than 39"):
        language.fit(df)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 40)
    monkeypatch.setattr(language, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer sample texts"):
        language.fit(df)


def test_prices_do_not_depend_on_the_step(monkeypatch):
    rng = np.random.default_rng(3)
    lang, gram, n = rng.integers(0, 7, 900), rng.integers(0, 3**5, 900).astype(np.uint64) * np.uint64(16843009), rng.integers(1, 9, 900)
    names = list("abcdefg")
    whole = language.price(names, lang, gram, n)["orders"]
    monkeypatch.setattr(language, "STEP", 3)
    for a, b in zip(whole, language.price(names, lang, gram, n)["orders"]):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_language_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("same words here", "b"), ("same words here", "a"), ("same words here", "c")], "text string, lang string")
    got = language.predict(df, language.fit(df)).collect()
    assert [r.lang_pred for r in got] == ["a"] * 3 and [round(r.score, 6) for r in got] == [round(1 / 3, 6)] * 3


def test_language_prediction(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ción", "ñez", "ll"]}
    say = lambda x: " ".join("".join(rng.choices(syllables[x], k=3)) for _ in range(rng.randrange(3, 40)))
    docs = [(i, say(x), x) for i, x in enumerate(list(syllables) * 60)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "bb"), (903, "— …", None), (904, "ka " * 50_000, None),
           (905, "日本", None), (906, "kato", None)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs + odd], "doc_id long, text string, lang string, score double")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert len(got) == len(docs) + len(odd)
    assert all(got[i][0] == x for i, _, x in docs)
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902, 903))
    assert got[904][0] == "aa" and got[905][0] != "und" and 0 < got[906][1] <= 1
    blank = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, blank).collect()} == {"und"}
    assert language.predict(df.limit(0), model).collect() == []


# ---- pieces

def piece_texts():
    rng = random.Random(9)
    chars = "abcdefghijklmno pqrstuvwxyzéñß日本語,.\n\t 0123"
    texts = [None, "", " ", "\n", "a" * 300, " " * 70 + "x", "x▁y", "🙂 é Ａ\u200b", "</s> <0x0A> <unk>", "word " * 4000, "\x00\x7f"]
    return texts + ["".join(rng.choice(chars) for _ in range(rng.randrange(200))) for _ in range(200)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = piece_texts()
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_pieces int")
    enc = pieces.encode(df)
    assert enc.columns == ["doc_id", "text", "piece_ids", "n_pieces"]
    rows = pieces.decode(enc).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.piece_ids == sp.encode(r.text or "") and r.n_pieces == len(r.piece_ids)
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.decode(pieces.encode(df.limit(0))).collect() == []


def test_decode_of_any_ids(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    df = spark.createDataFrame([([3 + 0xC3, 3 + 0xA9, 400],), ([],), (None,), ([28705, 28705, 500],)], "piece_ids array<int>")
    got = [r.decoded for r in pieces.decode(df).collect()]
    assert got == ["é" + sp.id_to_piece(400).replace("▁", " "), "", "", sp.decode([28705, 28705, 500])]


def long_units(rng):
    syllables = ["the", "a", "b", "ing", "er", "st", "é", "ñ", "q", "z", "Q", "0", "1", ".", "-", "日", "ti", "on", "=="]
    yield from ("".join(rng.choice(syllables) for _ in range(rng.randrange(300, 4000))) for _ in range(40))
    yield from ("a" * 5000, "=" * 3000 + "a" * 3000, "ab" * 2000, "the" * 2000, " " * 3000, "x" * 511, "x" * 512, "x" * 513)
    yield "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(5000))
    yield "".join(rng.choice("ab") for _ in range(20_000)) + " word " + "".join(rng.choice("abcdefgh") for _ in range(3000))


def test_long_units_equal_the_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    enc = pieces.Encoder(pieces.load_vocabulary())
    texts = list(long_units(random.Random(6)))
    at, ids = enc.encode(*W.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == sp.encode(t), t[:50]


def test_unspaced_text_is_not_much_slower(spark):
    """A text without a space takes at most ten times as long as one with spaces, and spans
    that do not fit still give the library's ids."""
    import time
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect() if r.text]
    spaced = " ".join(texts)[:400_000]

    def seconds(t):
        enc, start = pieces.Encoder(vocabulary), time.time()
        enc.encode(*W.utf8(pa.array([t])))
        return time.time() - start

    vocabulary = pieces.load_vocabulary()
    bare = "".join(spaced.split())
    rng = random.Random(1)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x5800)) for _ in range(100_000))
    for t in (bare, chinese):
        assert seconds(t) / len(t) < 10 * seconds(spaced) / len(spaced) + 1e-7


def test_spans_that_do_not_fit(monkeypatch):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    monkeypatch.setattr(pieces.Encoder, "encode_long", lambda *_: None)
    enc, t = pieces.Encoder(pieces.load_vocabulary()), "theingst" * 100
    assert enc.encode(*W.utf8(pa.array([t])))[1].tolist() == sp.encode(t)


# ---- pages

PROSE = "Plain words follow one another here without any mark. "


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("just words", "just words"), ("<p>a&nbsp;b &lt;c&gt; &#65;&amp;\n d", "a b <c> A& d"),
    ("<script>var x='<p>no</p>'", ""), ("<article><p>one<p>two<br>three<p></article><footer>no</footer>", "one\ntwo three"),
    ("<nav><a href=x>menu</a></nav><article><header><h1>T</h1></header><p>x</article>", "T\nx"),
    (f"<div class=main><h2>Head</h2><p>{PROSE * 4}</p><p>Short.</p><p>{PROSE * 3}</p></div><div id=Comments><p>{PROSE * 5}</div>",
     "Head\n" + (PROSE * 4).strip() + "\nShort.\n" + (PROSE * 3).strip()),
    (f"<header>Site</header><main><p>{PROSE}</p><aside>{PROSE}</aside><form><label>Mail</label></form></main>", PROSE.strip()),
    (f"<article><p>{PROSE}<div class='cookie-notice'>eat</div><p>end<div class=\"postAd\">buy</div></article>", PROSE.strip() + "\nend"),
])
def test_main_text(spark, html, text):
    assert main_text.content(html or "") == text


PARTS = [PROSE * 5, PROSE, PROSE * 4, "Short.", PROSE * 3, "The end."]


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("parts", [PARTS, [PROSE * 3] * 4])
def test_article_split_over_siblings(tag, parts):
    blocks = "".join(f"<{tag}><p>{x}</p></{tag}>" for x in parts)
    links = "<div>" + "".join(f"<a href=x>link {i}</a><br>" for i in range(30)) + "</div>"
    got = main_text.content(f"<body>{links}<div><h1>Head</h1>{blocks}</div>{links}")
    assert got == "\n".join(["Head", *(x.strip() for x in parts)])


def test_all_regions_and_articles_are_kept():
    links = "<div>" + "".join(f"<p><a href=x>link {i}</a></p>" for i in range(8)) + "</div>"
    one, two = PROSE * 6, PROSE * 4
    assert main_text.content(f"<div><p>{one}</p></div>{links}<div><p>{two}</p></div>") == one.strip() + "\n" + two.strip()
    got = main_text.content(f"<article><p>{PROSE * 9}</p></article><article><p>Brief.</p><p>So.</p></article>")
    assert got == (PROSE * 9).strip() + "\nBrief.\nSo."


@pytest.mark.parametrize("html,text", [
    (f"<head><title>T</title><body><article><p>{PROSE}</article>", PROSE.strip()),
    (f"<html><head><meta charset=x><title>T</title><article><p>{PROSE}</article>", PROSE.strip()),
    (f"<head><title>T</title>{PROSE}", PROSE.strip()),
    (f"<div class='content has-sidebar'><article><p>{PROSE}</article><div class=sidebar><p>{PROSE * 3}</div></div>", PROSE.strip()),
    (f"<div id=page-with-header><div class=header>Site</div><div><p>{PROSE * 3}</div></div>", (PROSE * 3).strip()),
    (f"<main><div class='content has-sidebar'><p>{PROSE * 2}</div></main>", (PROSE * 2).strip()),
    (f"<body><form action=x><input type=hidden><nav>menu</nav><article><p>{PROSE}</article><label>Mail</label>"
     f"<select><option>no</select></form>", PROSE.strip()),
    (f"<article><p>{PROSE}</article><div id=comments><article class=comment><p>{PROSE * 9}</article></div>", PROSE.strip()),
    (f"<div><p>{PROSE}</p></div><div class=comments><p>{PROSE * 9}</div><form class=search><p>find</p></form>", PROSE.strip()),
    (f"<article><p>{PROSE}</article><div class=related><article><p>teaser</article></div>", PROSE.strip()),
])
def test_layout_wrappers_forms_and_open_heads(html, text):
    assert main_text.content(html) == text


FIVE = "".join(f"<p>{PROSE * 4}</p>" for _ in range(5))
WHOLE = "\n".join([(PROSE * 4).strip()] * 5)
ONE = PROSE.strip()


@pytest.mark.parametrize("html,text", [
    # named articles hide no main text
    (f"<div class=content>{FIVE}</div><div class=grid><article><h3>One</h3></article><article><h3>Two</h3></article></div>", WHOLE),
    (f"<div class=content>{FIVE}</div><div class=grid>" + f"<article><h3><a href=x>T</a></h3><p>{PROSE * 3}</p></article>" * 2
     + "</div>", WHOLE),
    (f"<div class=post>{FIVE}</div><article><p>I agree, nice.</p></article><article><p>Me too.</p></article>", WHOLE),
    (f"<div class=post>{FIVE}<article><p>I agree, nice.</p></article><article><p>Me too.</p></article></div>", WHOLE),
    (f"<article>{FIVE}<section><article><p>I agree, nice.</p></article><article><p>Me too.</p></article></section></article>", WHOLE),
    (f"<article class=page><div><article>{FIVE}</article></div></article>", WHOLE),
    ("".join(f"<article><h2>Head {i}</h2><p>{PROSE * 3}</p></article>" for i in range(3)),
     "\n".join(f"Head {i}\n{(PROSE * 3).strip()}" for i in range(3))),
    (f"<main><h1>Title</h1><div class=body>{FIVE}</div></main>", "Title\n" + WHOLE),
    # a name is a whole token, and an everyday one needs a second sign inside an article
    (f"<article>{FIVE}<section id=related-work><h2>Related work</h2><p>{PROSE}</p></section></article>",
     f"{WHOLE}\nRelated work\n{ONE}"),
    (f"<article>{FIVE}<div class=market-share><p>{PROSE}</p></div></article>", f"{WHOLE}\n{ONE}"),
    (f"<article><div class=article-header><h1>A title</h1></div>{FIVE}</article>", f"A title\n{WHOLE}"),
    (f"<article><div class=header><h1>A title</h1></div>{FIVE}</article>", f"A title\n{WHOLE}"),
    (f"<article><p class='lead search'>{PROSE}</p>{FIVE}</article>", f"{ONE}\n{WHOLE}"),
    (f"<article>{FIVE}<div class=ad>Buy it all here and now, today.</div><ul class=share-buttons><li>Share</li></ul>"
     f"<div class=related-posts><a href=x>{PROSE}</a></div></article>", WHOLE),
    (f"<article><div class=search><input name=q> {PROSE}</div>{FIVE}</article>", WHOLE),
    # unseen text, short lines, containers of a line each
    (f"<article>{FIVE}<p style='display:none'>gone</p><p style='color:red;visibility: hidden'>gone</p></article>", WHOLE),
    ("<div>One two.</div><div>Three.</div><div>A longer line that says a bit more.</div>",
     "One two.\nThree.\nA longer line that says a bit more."),
    ("<p>One two.</p><p>Three.</p><p>A longer line that says a bit more.</p>",
     "One two.\nThree.\nA longer line that says a bit more."),
])
def test_articles_bound_regions_and_names_are_tokens(html, text):
    assert main_text.content(html) == text


def plain_kept(lines):
    """Lines above the border of the smoothed ratios, one line at a time."""
    x = [(len(t) - linked) / max(tags, 1) for t, tags, linked, _ in lines]
    y = []
    for i in range(len(x)):
        w = {j: np.exp(-((i - j) / main_text.SIGMA) ** 2 / 2) for j in range(len(x)) if abs(i - j) <= np.ceil(3 * main_text.SIGMA)}
        y.append(sum(w[j] * x[j] for j in w) / sum(w.values()))
    low, high = min(y), max(y)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in y if v < cut], [v for v in y if v >= cut]
        if not below or not above or (sum(below) / len(below), sum(above) / len(above)) == (low, high):
            break
        low, high = sum(below) / len(below), sum(above) / len(above)
    return [v >= cut for v in y], cut, y


def test_ratio_steps_agree_with_a_plain_version():
    rng = random.Random(8)
    for _ in range(200):
        html = "".join(rng.choice([
            lambda: f"<p>{PROSE * rng.randrange(1, 6)}</p>", lambda: f"<div><a href=x>{PROSE}</a></div>", lambda: "<p>Short.</p>",
            lambda: "<ul>" + "<li><a href=y>item</a></li>" * rng.randrange(1, 5) + "</ul>",
            lambda: f"<div><p>{PROSE}</p><p><b>{PROSE}</b> <i>x</i></p></div>"])() for _ in range(rng.randrange(1, 14)))
        lines, _, _ = main_text.lines_of(html)
        up, cut, y = plain_kept(lines)
        got = main_text.smooth(main_text.ratios(lines))
        assert np.allclose(got, y)
        border = main_text.threshold(got)
        assert border == pytest.approx(cut)
        assert all((g >= border) == u for g, u in zip(got, up) if abs(g - border) > 1e-9)
        # every unlinked line that is high before and after smoothing is in the text
        text = main_text.content(html).split("\n")
        assert all(line[0] in text for line, u, r in zip(lines, up, main_text.ratios(lines))
                   if u and r >= border and 2 * line[2] < len(line[0]))


def test_every_page_goes_through_the_clustering(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("html").collect()]
    calls = []
    monkeypatch.setattr(main_text, "threshold", lambda x, f=main_text.threshold: calls.append(len(x)) or f(x))
    texts = [main_text.content(h or "") for h in pages]
    assert len(calls) == sum(bool(main_text.lines_of(h or "")[0]) for h in pages) == sum(map(bool, texts)) > 0


def test_large_pages_take_linear_time():
    import time
    start = time.time()
    for html, n in (("<div>" * 50_000 + "x", 1), ("<article><p>aa bb cc</p></article>" * 20_000, 179_999),
                    ("<article>" * 20_000 + "x y z", 5), ("<p>a" * 50_000, 99_999)):
        assert len(main_text.content(html)) == n
    assert time.time() - start < 30


def test_extract(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "<p>" + "w " * 100_000, 3), (2, "<p>a", None)], "page_id long, html string, n_chars int")
    got = sorted((r.page_id, r.n_chars) for r in main_text.extract(df).collect())
    assert got == [(1, 0), (2, 1), (2, 199_999)]
    assert main_text.extract(df.limit(0)).collect() == []
    clash = df.selectExpr("*", "'kept' AS __html", "'too' AS __text")
    rows = main_text.extract(clash).collect()
    assert len(rows) == 3 and {(r["__html"], r["__text"]) for r in rows} == {("kept", "too")}


def test_smoothing_and_threshold():
    x = np.array([0, 0, 10, 10, 10, 0.0])
    s = main_text.smooth(x)
    assert len(s) == 6 and s.min() > 0 and s.max() < 10
    assert 2 < main_text.threshold(np.array([1, 2, 1, 9, 10.0])) < 9


# ---- licences

def test_alignment_is_a_common_subsequence():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(15))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(got) <= lcs[-1][-1]
    words = "the quick brown fox jumps over the lazy dog and the cat".split()
    assert len(licenses.align(["x"] * 3 + words + ["y"], words)) == len(words)


def test_longest_increasing():
    rng = random.Random(11)
    for _ in range(200):
        v = [rng.randrange(12) for _ in range(rng.randrange(12))]
        got = [v[i] for i in licenses.increasing(v)]
        best = max((len(c) for n in range(len(v) + 1) for c in combinations(v, n) if all(x < y for x, y in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(x < y for x, y in zip(got, got[1:]))


def test_license_scan(spark):
    grant = licenses.TEMPLATES[2][1]
    filler = "some words about nothing in the license of them " * 30
    texts = [None, "", filler, "Licensed under CC BY-NC 4.0.", filler + "LICENSED under the apache license version 2.0\n" + filler,
             grant.replace("merge", "blend") + " " + grant, "Released under the MIT License. " * 2, grant[:120], "All rights reserved.",
             filler * 300 + "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    names = [got[i].licenses for i in range(len(texts))]
    assert names == [[], [], [], ["CC-BY-NC-4.0"], ["Apache-2.0"], ["MIT", "MIT"], ["MIT", "MIT"], [], ["all-rights-reserved"], ["GPL-3.0"]]
    n = len(re.findall(r"\w+", filler))
    assert (got[4].span_starts, got[4].span_ends) == ([n], [n + 8]) and got[4].scores == [1.0]
    assert got[5].scores[0] < 1 == got[5].scores[1]
    assert licenses.scan(df.limit(0)).collect() == []


def plain_densest(pairs, size):
    best = (0.0, 0, 0, 0)
    for i in range(len(pairs)):
        for j in range(i, len(pairs)):
            score = 2 * (j - i + 1) / (size + pairs[j][0] - pairs[i][0] + 1)
            if score > best[0]:
                best = (score, j - i + 1, pairs[i][0], pairs[j][0] + 1)
    return best


def test_densest_run_equals_all_runs():
    rng = random.Random(4)
    for _ in range(400):
        at = sorted(rng.sample(range(80), rng.randrange(0, 25)))
        pairs, size = [(p, 0) for p in at], rng.randrange(1, 30)
        assert licenses.densest(pairs, size) == plain_densest(pairs, size)
    long = [(3 * i, 0) for i in range(20_000)]
    assert licenses.densest(long, 20_000)[1] == 20_000


def brute_scan(text, templates):
    """All stretches aligned, without the bounds that leave most of them out."""
    h = W.split_words(*W.utf8(pa.array([text])), "alnum")[3]
    found = []
    for name, words, need in licenses._prepared(templates):
        m = len(words)
        width, step = m + m // 4 + licenses.SLACK, max(1, m // 4)
        for s in range(0, max(1, len(h) - width + step), step):
            pairs = licenses.align(h[s:s + width].tolist(), words)
            score, matched, a, b = plain_densest(pairs, m)
            if score >= licenses.SCORE and matched >= licenses.COVERAGE * m and need <= {words[q] for p, q in pairs if a <= p < b}:
                found.append((name, score, s + a, s + b, m))
    out = []
    for name, score, a, b, _ in sorted(set(found), key=lambda f: (-f[1] * f[4], -f[1], f[2], f[0])):
        if all(b <= x or a >= y for _, _, x, y in out):
            out.append((name, score, a, b))
    return sorted(out, key=lambda f: f[2])


def test_scan_equals_a_scan_of_every_stretch(spark):
    rng = random.Random(9)
    some = [t for t in licenses.TEMPLATES if len(t[1]) < 260]
    v = " ".join(t[1] for t in some).split()
    docs = []
    for i in range(40):
        w = [rng.choice(v) for _ in range(rng.randrange(120))]
        for t in rng.sample(some, rng.randrange(3)):
            words = t[1].split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(["foo", "2.0", "3"])
            k = rng.randrange(len(w) + 1)
            w[k:k] = words
        docs.append((i, " ".join(w)))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=some).collect()
    for r in got:
        want = brute_scan(dict(docs)[r.doc_id], some)
        assert list(zip(r.licenses, r.scores, r.span_starts, r.span_ends)) == want
    assert sum(len(r.licenses) for r in got) > 20


@pytest.mark.parametrize("text,found", [
    ("licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    (licenses._GNU_GRANT.format("General Public License") + ", version 2 of the License, and no later version.", ["GPL-2.0-only"]),
    (licenses._GNU_GRANT.format("General Public License") + ", either version 2 of the License, or (at your option) any later "
     "version.", ["GPL-2.0"]),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]), ("Licensed under CC BY-NC-SA 2.5.", ["CC-BY-NC-SA-2.5"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
    (licenses._BSD + licenses._AS_IS, ["BSD-2-Clause"]), (licenses._BSD, ["BSD-2-Clause"]),
    (licenses._BSD + licenses._BSD_THIRD + licenses._AS_IS, ["BSD-3-Clause"]),
    (licenses._BSD.replace("1. ", "* ").replace("2. ", "* "), ["BSD-2-Clause"]),
    ("# SPDX-License-Identifier: MIT", ["MIT"]),
    ("a b // spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR Apache-2.0\nrest", ["Apache-2.0", "GPL-2.0-only"]),
    ("SPDX-License-Identifier:\nnothing", []), ("version 2 of the general plan", []),
])
def test_relatives_are_told_apart(spark, text, found):
    df = spark.createDataFrame([(1, text), (1, text), (2, "before it all and " + text + " and after it")], "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert len(got) == 3
    for r in got:
        assert sorted(x for x in r.licenses if x != "all-rights-reserved") == found


def test_templates_from_a_table(spark):
    long = " ".join(f"clause{i % 400} word{i}" for i in range(3000))
    table = spark.createDataFrame([("Long-1.0", long, ["word7"]), ("None", None, None), ("Empty", "...", None)],
                                  "license string, text string, required array<string>")
    templates = licenses.read_templates(table)
    words = long.split()
    edited = [w for i, w in enumerate(words) if i % 50]
    df = spark.createDataFrame([(1, "x y " + long + " z"), (2, " ".join(edited)), (3, long.replace("word7 ", "")), (4, None)],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, templates=templates).collect()}
    assert got[1].licenses == ["Long-1.0"] and (got[1].span_starts, got[1].span_ends) == ([2], [6002])
    assert got[2].licenses == ["Long-1.0"] and got[3].licenses == [] and got[4].licenses == []
    assert licenses.scan(df, templates=[]).where("size(licenses) > 0").count() == 0


# ---- urls

URLS = ["http://A.Example.ORG/es/1?q=1", "https://example.org/en/12", "https://example.org/en/2", "x://com/fr/", "ftp://a.com/de/x#y",
        "http://notorg/x", "http://b.org", "http://", "no scheme", "", None, "http://h?x=1://z", "a://B.net:80/P/Q.html?x&y=2#f", "http://é.org/ü?ß",
        "http://x.example.org/en/1/" + "long/" * 5000]


def test_given_rules_and_parts(spark):
    rules = [url_rules.Rule("org", "/", "allow"), url_rules.Rule("example.org", "/es/", "block"), url_rules.Rule("example.org", "/en/1", "block"),
             url_rules.Rule("com", "/fr/", "allow"), url_rules.Rule("com", "/de/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "doc_id long, block boolean")
    got = {r.page_id: r for r in url_rules.judge(pages, none, rules).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.host + best.path)
        assert got[i].verdict == (best.verdict if best else "allow")
    assert url_rules.judge(pages.limit(0), none, rules).collect() == []


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(200):
        host, word, key = rng.choice("ab"), rng.choice("uv"), rng.choice(["", "?k=1"])
        rows.append((i, f"http://{host}.net/{word}/{i}{key}", (host == "a" and word == "u" or rng.random() < 0.2) if i % 2 else None))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if b is not None] + [(1, None), (9999, True)], "doc_id long, block boolean")
    toks = {r.page_id: frozenset(r.t) for r in url_rules.with_parts(pages).select("page_id", url_rules.tokens().alias("t")).collect()}
    known = [(toks[i], b) for i, _, b in rows if b is not None]
    sets = {frozenset(c) for t, _ in known for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    conf = {}
    for s in sets:
        hit = [b for t, b in known if s <= t]
        if sum(hit) >= 5 and sum(hit) / len(hit) >= url_rules.MIN_CONFIDENCE:
            conf[s] = sum(hit) / len(hit)
    got = {r.page_id: (r.verdict, r.confidence) for r in url_rules.judge(pages, labels, [], min_rows=5).collect()}
    assert conf
    for i, _, _ in rows:
        best = max((c for s, c in conf.items() if s <= toks[i]), default=None)
        assert got[i][0] == ("block" if best else "allow")
        assert got[i][1] == (pytest.approx(best) if best else None)


@pytest.mark.parametrize("others", [0, 1000, 30_000])
def test_a_rule_needs_rows_not_a_share(spark, others):
    """Twenty blocked urls of a host are a rule among any number of other labels, nineteen none."""
    bad = [(i, f"http://bad.net/x{'abcdefghijklmnopqrst'[i]}/y", True) for i in range(20)]
    few = [(100 + i, f"http://few.net/z{'abcdefghijklmnopqrs'[i]}/y", True) for i in range(19)]
    rows = [*bad, *few, (200, "http://bad.net/new", None), (201, "http://few.net/new", None), (202, "http://c.net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    more = spark.range(1000, 1000 + others).select(
        "id", F.concat(F.lit("http://ok.net/p/"), F.col("id") % 50), F.lit(False))
    df = df.unionAll(more)
    got = {r.page_id: r.verdict for r in url_rules.judge(df.select("page_id", "url"), df.selectExpr("page_id AS doc_id", "block"),
                                                        []).where("page_id < 1000").collect()}
    assert got[200] == "block" and got[201] == ("block" if not others else "allow") and got[0] == "block"


def test_given_rules_equal_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = con.execute("""
      WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
      p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                   AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
      rules(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
      SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
      FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL""").fetchall()
    from driftlens.llm.queries import op10_url_filter
    got = {r.page_id: r for r in op10_url_filter(spark, SF_SMALL).collect()}
    assert len(got) == len(want) and sum(w[3] is not None for w in want) > 10
    for page, host, path, rule, verdict in want:
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule)
        assert rule is None or got[page].verdict == verdict


def test_urls_with_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "http://a.org/x", "h", "p", "b")] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, tokens string")
    got = url_rules.judge(df, spark.createDataFrame([(1, True)], "doc_id long, block boolean"), []).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.verdict) for r in got) == [
        (0, "", "", "allow"), (1, "a.org", "/x", "allow"), (1, "a.org", "/x", "allow")]


def test_url_filter_stays_in_the_jvm(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    labels = spark.range(len(URLS)).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).alias("block"))
    plan = url_rules.judge(pages, labels, [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
