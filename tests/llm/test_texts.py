"""Words, near-duplicates, positional index, line templates."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftlens.llm import line_templates, positional_index, superminhash
from driftlens.llm import words as W
from driftlens.llm.graph import connected_components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["Hello, World 12", None, "", " \t\n", "é ñ É日本", "a b c d", "x" * 5000 + " y", "one", "a  b\x0bc\x0cd\re",
         "A b A b A b A b", "\x00\x7f z", "nbsp word"]


def python_words(text, kind):
    return (SOLID if kind == "solid" else ALNUM).findall((text or "").translate(LOWER))


@pytest.mark.parametrize("kind", ["solid", "alnum"])
def test_words_match_the_patterns(kind):
    data, off = W.utf8(pa.array(TEXTS, pa.string()))
    row, start, length, h = W.split_words(data, off, kind)
    raw = data.tobytes()
    got = defaultdict(list)
    for r, s, n in zip(row.tolist(), start.tolist(), length.tolist()):
        got[r].append(raw[s:s + n].decode().translate(LOWER))
    assert [got[i] for i in range(len(TEXTS))] == [python_words(t, kind) for t in TEXTS]
    names = {}
    for r, s, n, x in zip(row.tolist(), start.tolist(), length.tolist(), h.tolist()):
        assert names.setdefault(raw[s:s + n].lower(), x) == x
    assert len(set(names.values())) == len(names)


def test_words_of_slices_and_chunks():
    b = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], names=["text"])
    whole = W.split_words(*W.utf8(b.column("text")), "solid")[3]
    parts = [W.split_words(*W.utf8(c.column("text")), "solid")[3] for c in W.chunks([b], "text", 64)]
    assert np.array_equal(whole, np.concatenate(parts))


def test_shingles():
    data, off = W.utf8(pa.array(TEXTS, pa.string()))
    row, _, _, h = W.split_words(data, off, "solid")
    row, g = W.distinct(*W.shingles(row, h, 5))
    size = np.bincount(row, minlength=len(TEXTS))
    for i, t in enumerate(TEXTS):
        w = python_words(t, "solid")
        assert size[i] == (len({tuple(w[k:k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w))


def test_blobs_round_trip():
    v, at = np.arange(10, dtype=np.uint64), np.array([0, 3, 3, 10])
    back, off = W.unblob(W.blobs(v, at).slice(1), np.uint64)
    assert back.tolist() == list(range(3, 10)) and off.tolist() == [0, 0, 7]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    rows = connected_components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert all(got.get(x, x) == root(x) for x in parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- near-duplicates

def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = python_words(t, "solid")
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_corpus(seed=0, groups=12, per=14):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    docs = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(per):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 30, len(w) // 12])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    docs += [None, "", " \n ", None, "", "one", "ONE", "two words", "x" * 200_000, " ".join(vocabulary * 40)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("rows", [512, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(superminhash, "BLOCK_ROWS", rows)
    docs = near_corpus()
    df = spark.createDataFrame([(i, t, 1, True, "z") for i, t in docs],
                               "doc_id long, text string, component_id int, kept boolean, sig string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_components(docs).items()}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert superminhash.near_duplicates(empty).collect() == []
    one = superminhash.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b")], "doc_id long, text string"))
    assert sorted(map(tuple, one.collect()), key=str) == [(3, 1, 3, True), (None, 1, None, True)]


def test_superminhash_is_unbiased_and_varies_less():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    b = np.concatenate([a[:150], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    est = []
    for t in range(200):
        x = np.concatenate([W.mix(a + np.uint64(t)), W.mix(b + np.uint64(t))])
        s = superminhash.signatures(np.repeat([0, 1], 200), x, 2)
        est.append((s[0] == s[1]).mean())
    j = 150 / 250
    assert abs(np.mean(est) - j) < 0.01
    assert np.std(est) < 0.95 * (j * (1 - j) / superminhash.M) ** 0.5


def test_superminhash_slots_of_small_sets_are_a_permutation():
    s = superminhash.signatures(np.zeros(1, np.int64), np.array([77], np.uint64), 2)
    assert sorted((s[0] >> np.uint64(48)).tolist()) == list(range(superminhash.M))
    assert (s[1] == np.uint64(2**64 - 1)).all()


# ---- positional index

def brute_contamination(docs, items, size=10):
    out = {}
    wins = []
    for item, t in items:
        w = python_words(t, "alnum")
        m = min(size, len(w))
        wins += [(item, tuple(w[i:i + m])) for i in range(len(w) - m + 1)] if m else []
    for i, t in docs:
        w = python_words(t, "alnum")
        hit, found = set(), set()
        for item, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    found.add(item)
                    hit.update(range(p, p + len(win)))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def contaminated_corpus():
    rng = random.Random(1)
    v = list("abcdefgh") + ["x%d" % i for i in range(30)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([2, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, "q"), (53, "Q! q")]
    docs = []
    for i in range(60):
        w = [rng.choice(v) for _ in range(rng.choice([0, 3, 30, 120]))]
        if rng.random() < 0.5:
            t = items[rng.randrange(12)][1].upper().split()
            k = rng.randrange(len(w) + 1)
            w[k:k] = t if rng.random() < 0.7 else t[1:14]
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "q"), (103, items[0][1] + " " + items[0][1]), (104, "q q q q")]
    return docs, items


@pytest.mark.parametrize("words,segment", [(400_000, 1 << 20), (30, 200)])
def test_contamination_equals_brute_force(spark, monkeypatch, words, segment):
    monkeypatch.setattr(positional_index, "BLOCK_WORDS", words)
    monkeypatch.setattr(positional_index, "SEGMENT_BYTES", segment)
    docs, items = contaminated_corpus()
    got = positional_index.contamination(
        spark.createDataFrame([(i, t, 0, []) for i, t in docs], "doc_id long, text string, n_hit int, items array<int>"),
        spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()}
    assert rows == brute_contamination(docs, items)


def test_contamination_of_nothing(spark):
    docs, items = contaminated_corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    got = positional_index.contamination(some, none).collect()
    assert len(got) == len(docs) and not any(r.n_hit or r["items"] for r in got)
    empty = positional_index.contamination(spark.createDataFrame([], "doc_id long, text string"),
                                           spark.createDataFrame(items, "item_id long, text string"))
    assert empty.collect() == []


def brute_proximity(docs, items, slop, size=10):
    """{doc: (hit words, items)}: every start inside a document from which all words of a
    window are at most ``slop`` places from their own."""
    out = {}
    for i, t in docs:
        w = python_words(t, "alnum")
        hit, found = set(), set()
        for item, text in items:
            v = python_words(text, "alnum")
            m = min(size, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                for s in range(len(w)):
                    if all(v[k + j] in w[max(s + j - slop, 0):s + j + slop + 1] for j in range(m)):
                        found.add(item)
                        hit.update(range(s, min(s + m, len(w))))
        out[i] = (len(hit), sorted(found))
    return out


@pytest.mark.parametrize("slop", [0, 1, 2, 3, 20])
@pytest.mark.parametrize("words,segment", [(400_000, 1 << 20), (30, 100)])
def test_proximity_equals_brute_force(spark, monkeypatch, slop, words, segment):
    """Also with other documents in the same segment, and at the heads of documents."""
    monkeypatch.setattr(positional_index, "BLOCK_WORDS", words)
    monkeypatch.setattr(positional_index, "SEGMENT_BYTES", segment)
    rng = random.Random(slop)
    items = [(1, "a b c d e f g h i j"), (2, "x y"), (3, "a b a b a b c c"), (4, "z"), (5, "k l m n o p q r s t u v a b")]
    docs = [(1, "a b c d e f g h i j"), (2, "a b c x d e f g h i j"), (3, "b a c d e f g h i j"), (4, "a b c x y z d e f g h i j"),
            (5, "a b c d e f g h j i"), (6, "a b c d e f g h j i k a b c d e f g h i"), (7, "x y z"),
            (8, "a b c d e f g h i j k a b c d e f g h i"), (9, ""), (10, None), (11, "y"), (12, "j"), (13, "b c d e f g h i j")]
    docs += [(20 + i, " ".join(rng.choice("abcdefghijxyz") for _ in range(rng.randrange(40)))) for i in range(30)]
    got = positional_index.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
                                         spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    rows = {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()}
    assert rows == brute_proximity(docs, items, slop)


def test_slop_beyond_the_gap_is_refused(spark):
    docs, items = (spark.createDataFrame([(1, "a")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    for slop in (-1, positional_index.GAP - 9, positional_index.GAP):
        with pytest.raises(ValueError, match="slop"):
            positional_index.contamination(docs, items, slop=slop)


@pytest.mark.parametrize("words", [400_000, 10])
def test_rows_of_one_id_are_documents_of_their_own(spark, monkeypatch, words):
    monkeypatch.setattr(positional_index, "BLOCK_WORDS", words)
    docs = [(1, "a b c d e f g h i j"), (1, "x"), (1, "a b c d e f g h i j"), (2, "k l m n o p q r s t"), (2, None)]
    items = [(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t"), (3, "u v w"), (4, "x y z")]
    got = positional_index.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(2),
                                         spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == [
        (1, 1, 0, []), (1, 10, 10, [1]), (1, 10, 10, [1]), (2, 0, 0, []), (2, 10, 10, [2])]


# ---- line templates

def brute_witnesses(rows):
    """The smallest id of each document's group of copies, from (doc, pos, leaf, line)."""
    sets = defaultdict(set)
    for i, _, leaf, _ in rows:
        sets[i].add(leaf)
    hub = {}
    for i in sorted(sets):
        for leaf in sets[i]:
            hub.setdefault(leaf, i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        first = Counter(hub[leaf] for leaf in sets[i] if hub[leaf] != i)
        if first:
            h = min(first, key=lambda h: (-first[h], h))
            k = len(sets[i] & sets[h])
            if k >= line_templates.COPY_SIMILARITY * (len(sets[i]) + len(sets[h]) - k):
                a, b = root(i), root(h)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def brute_lines(docs, min_docs=3):
    """The module's rules, written for one machine."""
    rows = []
    for i, t in docs:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            w = [x for x in re.sub(r"[ \t\n\x0B\f\r]+", " ", line).strip(" ").split(" ")]
            w = ["<*>" if re.search("[0-9]", x) else x for x in w]
            if len(w) >= line_templates.MIN_TOKENS:
                rows.append((i, pos, (len(w), tuple(w[:line_templates.DEPTH])), tuple(w)))
    witness = brute_witnesses(rows)
    lines = defaultdict(set)               # witnesses of each line
    for i, _, leaf, w in rows:
        lines[leaf, w].add(witness[i])
    by_leaf = defaultdict(list)
    for leaf, w in lines:
        by_leaf[leaf].append(w)
    dropped = set()
    for leaf, ws in by_leaf.items():
        docs_of = {w: len(lines[leaf, w]) for w in ws}
        own = defaultdict(list)
        for w in ws:
            for x in lines[leaf, w]:
                own[x].append(w)
        if len(own) < min_docs:
            continue
        # equally seen lines of one witness are told apart by a hash: no such tie in these corpora matters
        share = Counter(max(mine, key=lambda w: docs_of[w]) for mine in own.values())
        count, most = Counter(), Counter()
        for w in ws:
            for p, x in enumerate(w):
                count[p, x] += share[w]
                most[p, x] = max(most[p, x], docs_of[w])
        size, best, shape = Counter(), Counter(), {}
        for w in ws:
            s = tuple(x if x != "<*>" and max(count[p, x], most[p, x]) >= min_docs else None for p, x in enumerate(w))
            if docs_of[w] >= min_docs or sum(x is not None for x in s) >= line_templates.SIMILARITY * len(w):
                shape[w] = s
                size[s] += share[w]
                best[s] = max(best[s], docs_of[w])
        dropped |= {(leaf, w) for w, s in shape.items() if max(size[s], best[s]) >= min_docs}
    out = {}
    for i, t in docs:
        cut = {r[1] for r in rows if r[0] == i and (r[2], r[3]) in dropped}
        left = [x for p, x in enumerate((t or "").split("\n")) if p not in cut]
        whole = not "".join(left).strip()
        out[i] = (t if t is None or not cut or whole else "\n".join(left), 0 if t is None else t.count("\n") + 1,
                  0 if whole else len(cut))
    return out


def line_corpus():
    rng = random.Random(4)
    v = ["k%s" % c for c in string.ascii_letters]
    prose = lambda n: " ".join(rng.choice(v) for _ in range(n))
    docs = []
    for i in range(40):
        lines = [prose(rng.choice([1, 2, 8, 20])) for _ in range(rng.randrange(4, 12))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), "Posted on 2024-01-%02d at 10:%02d by staff" % (i % 28, i))
        if i % 4 == 0:
            lines.append("All rights reserved here")
        if i % 5 == 0:
            lines.insert(0, "The user named %s has logged in from home today" % rng.choice(v))
        docs.append("\n".join(lines))
    copy = "\n".join(prose(12) for _ in range(6))
    docs += [copy] * 6 + [copy + "\nAll rights reserved here"] * 2
    docs += [None, "", "\n\n", "All rights reserved here", "a\tb  c\n" + prose(30), prose(3000)]
    return list(enumerate(docs))


def test_lines_equal_brute_force(spark):
    docs = line_corpus()
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], "doc_id long, text string, leaf string, n_dropped int")
    got = line_templates.drop_recurring_lines(df)
    assert got.columns == ["doc_id", "text", "leaf", "n_lines", "n_dropped"]
    rows = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    expected = brute_lines(docs)
    assert rows == expected
    assert sum(x[2] for x in expected.values()) > 20
    text = {i: t for i, t in docs}
    assert all("rights" not in (rows[i][0] or "") for i in rows if "rights" in (text[i] or "") and "\n" in text[i])
    assert rows[40][0] == text[40]                       # copies keep their own lines
    assert rows[51][0] == "All rights reserved here"     # a document is never emptied


@pytest.mark.parametrize("own", [0, 1, 40, 80])
@pytest.mark.parametrize("lines", [1, 5])
def test_a_passage_shared_by_short_documents(spark, own, lines):
    """60 documents with one passage of 60 words: it is dropped whatever else they hold,
    but documents of nothing else are copies of each other."""
    rng = random.Random(own + lines)
    v = [a + b + c for a in string.ascii_lowercase for b in "aeiou" for c in string.ascii_lowercase]
    passage = " ".join(rng.choice(v) for _ in range(60))
    docs = []
    for i in range(60):
        mine = [" ".join(rng.choice(v) for _ in range(max(own // lines, own and 3))) for _ in range(lines)] if own else []
        docs.append((i, "\n".join([*mine, passage])))
    got = line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == (60 if own else 0)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == brute_lines(docs)


def test_near_copies_are_one_witness(spark):
    """A large group of copies, each with an edit of its own, keeps its lines; what other
    documents share with it goes."""
    rng = random.Random(11)
    v = [a + b + c for a in string.ascii_lowercase for b in "aeiou" for c in string.ascii_lowercase]
    base = [" ".join(rng.choice(v) for _ in range(20)) for _ in range(12)]
    docs = []
    for i in range(50):
        own = list(base)
        w = own[i % 12].split()
        w[rng.randrange(5, 20)] = rng.choice(v)          # the leaf stays
        own[i % 12] = " ".join(w)
        if i % 3 == 0:
            own.append(" ".join(rng.choice(v) for _ in range(9)))
        if i % 2:
            own.append("Read more of this on our front page")
        docs.append((i, "\n".join(own)))
    docs += [(100 + i, " ".join(rng.choice(v) for _ in range(50)) + "\nRead more of this on our front page") for i in range(4)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in
           line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)
    assert all(n == (i % 2 if i < 100 else 1) for i, (_, _, n) in got.items())


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame(line_corpus(), "doc_id long, text string").selectExpr(
        "*", "1 AS __id", "2 AS __cut", "3 AS __lines", "4 AS __left", "5 AS witness")
    got = line_templates.drop_recurring_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()} == brute_lines(line_corpus())
    assert {(r["__id"], r["__cut"], r["__lines"], r["__left"], r.witness) for r in got.collect()} == {(1, 2, 3, 4, 5)}


def test_lines_of_nothing(spark):
    empty = line_templates.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []
    null = line_templates.drop_recurring_lines(spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id long, text string"))
    assert sorted(map(tuple, null.collect()), key=str) == [(1, None, 0, 0), (None, "a b c", 1, 0)]


def test_lines_stay_in_the_jvm(spark):
    df = spark.createDataFrame(line_corpus(), "doc_id long, text string")
    plan = line_templates.drop_recurring_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
