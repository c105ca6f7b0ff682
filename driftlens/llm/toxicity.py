"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The fit reads a bounded sample of labelled texts (``max_examples``, by a hash of the
id): it joins near copies to one witness (equal signatures, or min-hash bands and a
check of the whole signature), selects the terms that tell the labels apart best
(chi-squared over witness counts), takes their document frequencies over all documents, and keeps the
examples' weights. Scoring is one pass over the texts without any shuffle: every
task holds the examples as an inverted index in blocks with the largest weight of
each term per block. A block is opened for a text only if its upper bound reaches
the k-th best cosine found so far, so the neighbours are exact. Their
distance-weighted votes are mapped to label rates by a monotone calibration, learned
leave-one-out on the examples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import require_columns
from . import words as W
from .scratch import materialise
from .superminhash import BANDS, M, signatures

MAX_EXAMPLES, TERMS, MIN_DOCS = 8192, 256, 4
MIN_CHI2 = 30.0  # with Yates' correction, so that a few chance meetings select no term
MIN_SHARE, MIN_ODDS = 0.01, 4.0  # witnesses of a term among those of label 1; label odds of its holders by those of the others
SHINGLE, SAME = 3, 0.7  # words; share of equal signature slots from which two texts are one witness
NEIGHBOURS, BLOCK = 15, 64
THRESHOLD = 0.3
_SPACE = 0.1     # added to a distance, so that an equal text has a finite weight
_PSEUDO = 1.0    # weight of the base rate beside the votes


@dataclass
class Model:
    terms: np.ndarray      # sorted term hashes
    idf: np.ndarray
    ids: np.ndarray        # examples, in index order
    labels: np.ndarray
    weights: np.ndarray    # examples x terms, rows of length 1
    block_max: np.ndarray  # terms x blocks
    base: float            # label rate of the sample
    empty: float           # label rate of examples that hold no selected term
    votes: np.ndarray      # calibration: ascending votes and their rates
    rates: np.ndarray


def count_terms(terms: np.ndarray, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x terms occurrence counts."""
    out = np.zeros((n, len(terms)), np.float32)
    if len(terms) and len(h):
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[at] == h
        np.add.at(out, (row[hit], at[hit]), 1)
    return out


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
    return np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)


def index(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, block maxima): examples with like heaviest terms share blocks."""
    order = np.argsort(weights.argmax(axis=1), kind="stable") if weights.size else np.arange(len(weights))
    w = weights[order]
    blocks = -(-len(w) // BLOCK)
    top = np.zeros((weights.shape[1], blocks))
    for b in range(blocks):
        top[:, b] = w[b * BLOCK:(b + 1) * BLOCK].max(axis=0)
    return order, top


def nearest(q: np.ndarray, weights: np.ndarray, block_max: np.ndarray, k: int):
    """(positions, cosines) of the k nearest examples of each row of ``q``, exact;
    best first, ties to the smaller position, -1 and 0 where there are fewer."""
    n, blocks = len(q), block_max.shape[1]
    pos, cos = np.full((n, k), -1, np.int64), np.zeros((n, k))
    if not n or not blocks:
        return pos, cos
    bound = q @ block_max

    def open_block(b, rows):
        part = weights[b * BLOCK:(b + 1) * BLOCK]
        c = np.concatenate([cos[rows], q[rows] @ part.T], axis=1)
        p = np.concatenate([pos[rows], np.broadcast_to(np.arange(b * BLOCK, b * BLOCK + len(part)),
                                                       (len(rows), len(part)))], axis=1)
        c = np.where(p >= 0, np.round(c, 12), -1.0)
        best = np.lexsort((p, -c))[:, :k]
        cos[rows] = np.maximum(np.take_along_axis(c, best, 1), 0)
        found = np.take_along_axis(p, best, 1)
        pos[rows] = np.where(cos[rows] > 0, found, -1)

    first = bound.argmax(axis=1)
    for b in np.unique(first):
        open_block(b, np.flatnonzero(first == b))
    for b in range(blocks):
        rows = np.flatnonzero((bound[:, b] >= cos[:, -1] - 1e-9) & (bound[:, b] > 0) & (first != b))
        if len(rows):
            open_block(b, rows)
    return pos, cos


def _vote(cos: np.ndarray, y: np.ndarray, base: float) -> np.ndarray:
    w = np.where(cos > 0, 1.0 / (1.0 - np.minimum(cos, 1.0) + _SPACE), 0.0)
    return ((w * y).sum(axis=1) + _PSEUDO * base) / (w.sum(axis=1) + _PSEUDO)


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators; ties in x are one point."""
    xs, inv = np.unique(x, return_inverse=True)
    size = np.bincount(inv).astype(float)
    mean = np.bincount(inv, weights=y) / size
    pools: list[list[float]] = []
    for m, s in zip(mean, size):
        pools.append([m, s, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, s2, c2 = pools.pop()
            m1, s1, c1 = pools.pop()
            pools.append([(m1 * s1 + m2 * s2) / (s1 + s2), s1 + s2, c1 + c2])
    return xs, np.concatenate([np.full(int(c), m) for m, _, c in pools]) if pools else xs


def witnesses(sig: np.ndarray) -> np.ndarray:
    """Number of the witness that each signature (n x M) belongs to. A signature joins
    the earlier leader that it resembles most, from ``SAME`` on, among those that share
    a band with it; else it leads, so no chain of copies joins unlike texts."""
    keys = np.ascontiguousarray(sig).view(np.uint64).reshape(-1, BANDS)
    leaders: dict[tuple[int, int], list[int]] = {}
    out = np.arange(len(sig))
    for i, bands in enumerate(keys.tolist()):
        near = np.array(sorted({j for band in enumerate(bands) for j in leaders.get(band, ())}), np.int64)
        same = (sig[near] == sig[i]).mean(axis=1)
        if len(near) and same.max() >= SAME:
            out[i] = near[same.argmax()]
        else:
            for band in enumerate(bands):
                leaders.setdefault(band, []).append(i)
    return out


def build(ids, labels, counts, terms, df, n_docs, share=None) -> Model:
    """Index and calibration from the examples' term counts; ``share`` is the part of a
    witness that each example is (1 by default)."""
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    w = _unit(counts, idf)
    share = np.ones(len(labels)) if share is None else share
    base = float((labels * share).sum() / share.sum()) if len(labels) else 0.0
    some = w.any(axis=1)
    empty = float(((labels * share)[~some].sum() + _PSEUDO * base) / (share[~some].sum() + _PSEUDO))
    ids, labels, w = ids[some], labels[some], w[some]
    order, top = index(w)
    ids, labels, w = ids[order], labels[order], w[order]
    pos, cos = nearest(w, w, top, NEIGHBOURS + 1)
    own = pos == np.arange(len(w))[:, None]
    own[~own.any(axis=1), -1] = True  # pushed out by ties: drop the last instead
    keep = np.argsort(own, axis=1, kind="stable")[:, :NEIGHBOURS]
    pos, cos = np.take_along_axis(pos, keep, 1), np.take_along_axis(cos, keep, 1)
    votes, rates = monotone(np.round(_vote(cos, labels[pos] if len(w) else pos, base), 9), labels.astype(float))
    return Model(terms, idf, ids, labels, w, top, base, empty, votes, rates)


def judge(model: Model, counts: np.ndarray):
    """(score, neighbour positions, cosines) for rows of term counts."""
    keys, inv = np.unique(counts, axis=0, return_inverse=True)
    inv = inv.reshape(-1)
    q = _unit(keys, model.idf)
    pos, cos = nearest(q, model.weights, model.block_max, NEIGHBOURS)
    y = np.where(pos >= 0, model.labels[pos] if len(model.labels) else 0, 0)
    vote = _vote(cos, y, model.base)
    score = np.interp(vote, model.votes, model.rates) if len(model.votes) else vote
    score = np.where((pos >= 0).any(axis=1), score, model.empty)
    return np.clip(score, 0, 1)[inv], pos[inv], cos[inv]


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.chunks(batches, "text"):
        row, _, _, h = W.split_words(*W.utf8(b.column("text")), "alnum")
        texts = W.distinct(*W.shingles(row, h, SHINGLE))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else order
        tf = np.diff(np.append(head, len(h))).astype(np.int32)
        at = W.ptr(row[head], b.num_rows)
        sig = (W.mix(signatures(*texts, b.num_rows)) >> np.uint64(48)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("toxic"), W.blobs(h[head], at), W.blobs(tf, at),
             W.blobs(sig.reshape(-1), np.arange(b.num_rows + 1) * M)], names=["doc_id", "toxic", "terms", "tf", "sig"])


def _term_witnesses(kin: dict[bytes, int]):
    """(term, toxic, kin): ``kin`` has the witness of each signature, so a group of
    copies is not many witnesses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = W.unblob(b.column("terms"), np.uint64)
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            own = np.array([kin[s] for s in b.column("sig").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(b.column("toxic").to_numpy()[row]), pa.array(own[row])],
                names=["term", "toxic", "kin"])
    return run


def _frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for b in W.chunks(batches, "text"):
            row, _, _, h = W.split_words(*W.utf8(b.column("text")), "alnum")
            total += (count_terms(terms, row, h, b.num_rows) > 0).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(len(terms)), -1)), pa.array(np.append(total, n))], names=["term", "n"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, n_terms: int = TERMS) -> Model:
    """Learn from at most about ``max_examples`` labelled documents (a share of the
    ids by hash, so the same at every run); idf comes from all of ``docs``.

    Labels that are null or belong to no document are ignored; several labels of one
    document count as the largest. Without labels every score is 0."""
    require_columns(docs, [id_col, text_col], "toxicity documents")
    require_columns(labels, [id_col, label_col], "toxicity labels")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = max_examples / max(marked.count(), 1)
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1 << 20)) < int(share * (1 << 20)))
    # bounded by max_examples, so it may be broadcast
    examples = materialise(text.join(F.broadcast(marked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(
        _example_terms, "doc_id long, toxic int, terms binary, tf binary, sig binary"))
    found = sorted((bytes(r[0]), r[1]) for r in examples.select("sig", "toxic").distinct().collect())
    sigs = sorted({s for s, _ in found})
    kin = dict(zip(sigs, witnesses(np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, M)).tolist()))
    held = {(kin[s], y) for s, y in found}
    n, pos = len(held), sum(y for _, y in held)
    seen = examples.select("toxic", "terms", "sig").mapInArrow(
        _term_witnesses(kin), "term long, toxic int, kin long").distinct()
    count = seen.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).where(F.col("n") >= MIN_DOCS)
    gap = F.greatest(F.abs(F.col("n1") * n - F.col("n") * pos) - F.lit(n) / 2, F.lit(0.0))
    chi2 = gap * gap * n / (F.col("n").cast("double") * F.greatest(n - F.col("n"), F.lit(1)) * max(pos, 1) * max(n - pos, 1))
    # an odds ratio can be reached at any base rate, a lift only below its inverse
    others1, others = pos - F.col("n1"), n - F.col("n")
    odds = ((F.col("n1") + 0.5) * (others - others1 + 0.5)) / ((F.col("n") - F.col("n1") + 0.5) * (others1 + 0.5))
    common = (F.col("n1") >= MIN_SHARE * pos) & (odds >= MIN_ODDS)
    top = (count.where(common).select("term", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2)
           .orderBy(F.desc("chi2"), "term").limit(n_terms).collect())
    terms = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    freq = {r[0]: r[1] for r in text.mapInArrow(_frequencies(terms), "term long, n long")
            .groupBy("term").agg(F.sum("n")).collect()}
    df = np.array([freq.get(i, 0) for i in range(len(terms))], float)
    rows = examples.mapInArrow(_selected(terms), "doc_id long, toxic int, counts binary, sig binary").orderBy("doc_id").collect()
    counts = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float32).reshape(len(rows), len(terms))
    whose = [(kin[bytes(r[3])], r[1]) for r in rows]
    size = Counter(whose)
    return build(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), counts,
                 terms, df, float(freq.get(-1, 0)), np.array([1 / size[x] for x in whose]))


def _selected(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = W.unblob(b.column("terms"), np.uint64)
            tf, _ = W.unblob(b.column("tf"), np.int32)
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            out = np.zeros((b.num_rows, len(terms)), np.float32)
            if len(terms) and len(h):
                p = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = terms[p] == h
                out[row[hit], p[hit]] = tf[hit]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"),
                 W.blobs(out.reshape(-1), np.arange(b.num_rows + 1) * len(terms)), b.column("sig")],
                names=["doc_id", "toxic", "counts", "sig"])
    return run


_ADDED = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    T.StructField("evidence_ids", T.ArrayType(T.LongType())),
    T.StructField("evidence_cosines", T.ArrayType(T.DoubleType()))])


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD,
          keep=None) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 if score >= threshold), evidence_ids
    and evidence_cosines (nearest examples with a positive cosine, best first).

    ``keep`` names the columns that go through (all by default); one with a result's
    name is replaced. Null and empty texts, and texts without any selected term, get
    the label rate of the examples without one and no evidence. Whole texts count."""
    require_columns(docs, [text_col], "toxicity score")
    added = [f.name for f in _ADDED.fields]
    names = [c for c in (keep or docs.columns) if c not in added]
    out = T.StructType([docs.schema[c] for c in names] + _ADDED.fields)
    # bounded by max_examples x n_terms; plain arrays, so that executors need no class of ours
    held = docs.sparkSession.sparkContext.broadcast(vars(model))
    src, column = W.with_text(docs, names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**held.value)
        for b in W.chunks(batches, column):
            row, _, _, h = W.split_words(*W.utf8(b.column(column)), "alnum")
            s, pos, cos = judge(m, count_terms(m.terms, row, h, b.num_rows))
            some = pos >= 0
            at = pa.array(np.append(0, np.cumsum(some.sum(axis=1))).astype(np.int32))
            ids = m.ids[pos[some]] if len(m.ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(s), pa.array((s >= threshold).astype(np.int32)),
                 pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(cos[some]))],
                names=[*names, *added])

    return src.mapInArrow(run, out)
