"""Near-duplicate texts by SuperMinHash signatures, banding and exact verification.

Every distinct shingle of a document draws one permutation of the ``M`` signature
slots, slot by slot: at step j it offers j plus a uniform fraction to the slot that
its Fisher-Yates shuffle yields. The ranks of one element are thus correlated and
spread over all slots, which lowers the variance against plain MinHash, and a
document stops as soon as no later step can lower any slot.

1. one pass over the texts: set size, 128-bit identity of the set, band keys, signature;
2. equal sets form one class (a partially aggregated minimum), only its
   representative goes on;
3. representatives that share a band form candidate groups (components of links to
   the smallest member of a bucket, never of pairs);
4. each candidate group is dealt in blocks of bounded rows and bytes; a task sees
   two blocks, estimates similarities from the signatures and confirms on the full
   sets until its union-find has nothing left to join. Only the links of the
   spanning forest leave the task, so a group of n copies costs O(n) rows.
5. components over copies and confirmed links.

With 32 bands of 4 slots a pair at similarity 0.75 shares no band with probability
5e-6; a confirmed pair is never estimated below ``FLOOR`` but with one of 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded, require_columns
from . import words as W
from .graph import connected_components
from .scratch import materialise

M, BANDS = 128, 32
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
FLOOR = 0.58
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(row: np.ndarray, h: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """SuperMinHash signatures (n x m uint64) of ``n`` sets, given the distinct
    (row, hash) of their elements with ascending rows. A value is the step (high
    16 bits) and the fraction; an empty set keeps the largest value in each slot."""
    sig = np.full((n, m), _TOP, np.uint64)
    flat = sig.reshape(-1)
    perm = None
    j = 0
    while len(row) and j < m:
        draw = W.mix(h + np.uint64((2 * j + 1) * 0xA0761D6478BD642F % 2**64))
        k = j + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(48)) | (W.mix(draw ^ _TOP) >> np.uint64(16))
        if perm is None:
            slot = k
        else:
            i = np.arange(len(row))
            slot = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
        np.minimum.at(flat, row * m + slot, value)
        open_ = (sig >= (np.uint64(j + 1) << np.uint64(48))).any(axis=1)[row]
        if perm is None:  # most elements are done after the first step
            row, h, k = row[open_], h[open_], k[open_]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(row), 1))
            perm[np.arange(len(row)), k] = 0
        elif not open_.all():
            row, h, perm = row[open_], h[open_], perm[open_]
        j += 1
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = sig.shape
    part = sig.reshape(n, bands, m // bands)
    pw = W.powers(W._Q, m // bands)
    return W.mix((part * pw).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * W._P)


def _profile(id_col: str, text_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, text_col):
            n = b.num_rows
            data, off = W.utf8(b.column(text_col))
            row, _, _, h = W.split_words(data, off, "solid")
            row, h = W.distinct(*W.shingles(row, h, k))
            at = W.ptr(row, n)
            sig = signatures(row, h, n)
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(s1, row, W.mix(h ^ W._P))
            np.add.at(s2, row, W.mix(h ^ W._Q))
            every = np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).cast(pa.int64()), pa.array(np.diff(at).astype(np.int64)),
                 pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 W.blobs(band_keys(sig).reshape(-1), every * BANDS),
                 W.blobs((W.mix(sig) >> np.uint64(48)).astype(np.uint16).reshape(-1), every * M)],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "sig"])
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, _ = W.unblob(b.column("bands"), np.int64)
        ids = np.repeat(b.column("doc_id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["band", "doc_id"])


def _sets(text_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, text_col):
            row, _, _, h = W.split_words(*W.utf8(b.column(text_col)), "solid")
            row, h = W.distinct(*W.shingles(row, h, k))
            cols = [b.column(c) for c in b.schema.names if c != text_col]
            names = [c for c in b.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*cols, W.blobs(h, W.ptr(row, b.num_rows))],
                                             names=[*names, "elements"])
    return run


def links_between(ids, block, sig, sets, num: int, den: int, x: int, y: int) -> list[tuple[int, int]]:
    """Spanning links between blocks ``x`` and ``y`` (equal: within it): pairs whose
    sets satisfy den * intersection >= num * union, best estimates first, skipping
    what union-find has joined already."""
    a, c = np.flatnonzero(block == x), np.flatnonzero(block == y)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    est = np.zeros((len(a), len(c)), np.int16)
    for s in range(sig.shape[1]):
        est += sig[a, s][:, None] == sig[c, s][None, :]
    size = np.array([len(s) for s in sets])
    low, high = np.minimum(size[a][:, None], size[c]), np.maximum(size[a][:, None], size[c])
    ok = (est >= FLOOR * sig.shape[1]) & (den * low >= num * high)
    if x == y:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    order = np.argsort(-est[i, j], kind="stable")
    out = []
    for p, q in zip(a[i[order]].tolist(), c[j[order]].tolist()):
        rp, rq = root(p), root(q)
        if rp == rq:
            continue
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if den * both >= num * (len(sets[p]) + len(sets[q]) - both):
            parent[rp] = rq
            out.append((int(ids[p]), int(ids[q])))
    return out


def _verify(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        sig = W.unblob(pa.concat_arrays(t["sig"].chunks), np.uint16)[0].reshape(t.num_rows, -1)
        values, at = W.unblob(pa.concat_arrays(t["elements"].chunks), np.uint64)
        sets = [values[at[i]:at[i + 1]] for i in range(t.num_rows)]
        found = links_between(t["doc_id"].to_numpy(), t["block"].to_numpy(), sig, sets, num, den, x, y)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()),
                         "b": pa.array([f[1] for f in found], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable
    over links, itself included) and kept (doc_id = component_id).

    Two documents are linked when den * |A n B| >= num * |A u B| over their distinct
    ``k``-word shingles. Null and empty texts, and texts without words, have an empty
    set and no links. Texts with the same words are linked whatever their white
    space. A null id is kept as a row of its own with a null component. Other columns
    are ignored, whatever their names; ids must be unique."""
    require_columns(docs, [id_col, text_col], "near_duplicates")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prof = materialise(src.mapInArrow(
        _profile("doc_id", "text", k),
        "doc_id long, n_shingles long, s1 long, s2 long, bands binary, sig binary"))
    ident = ["s1", "s2", "n_shingles"]
    full = prof.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(full.groupBy(*ident).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    copies = (full.select("doc_id", *ident).join(classes.where("copies > 1").drop("copies"), ident)
              .where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    # a class id is a document of its own, so the smallest of a class stands for it
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    rows = reps.select("doc_id", "bands").mapInArrow(_bands, "band long, doc_id long")
    buckets = rows.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(buckets.drop("n"))
    near = (rows.join(buckets, "band").where("doc_id <> pivot")
            .select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
    group = materialise(connected_components(near))

    cand = materialise(group.join(prof.select(F.col("doc_id").alias("node"), "n_shingles", "sig"), "node"))
    size = cand.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("e"))
    size = size.select("component", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS),
                                               F.ceil(F.col("e") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    many = materialise(size.where("blocks > 1"))
    ids = cand.select(F.col("node").alias("doc_id"), "component", "sig")
    texts = src.join(broadcast_if_bounded(ids.select("doc_id"), 1_000_000), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets("text", k), "doc_id long, elements binary")
    dealt = (sets.join(ids, "doc_id").join(broadcast_if_bounded(many, 100_000), "component", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                     "doc_id", "block", "sig", "elements"))
    links = dealt.groupBy("component", "x", "y").applyInArrow(_verify(num, den), "a long, b long")
    comp = connected_components(copies.unionAll(links))
    return (prof.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
