"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed in segments of bounded size, one table row each:
document ids and lengths, the sorted terms, and for every term its ascending token
positions (counted through the segment, with a gap between documents). The table is
written to the shared folder; searching reads it without any shuffle.

Test items are cut into windows. In a segment a window starts from its rarest term:
the positions of that term, moved back by the term's offset, are the candidate
starts, and the lists of the other terms, rarest first, are intersected with them at
their own offsets. With ``slop`` 0 a surviving start is an exact phrase match. With more it is a
proximity match: a place of the document such that every term lies, inside the document,
at most ``slop`` places from where the phrase starting there has it. All starts near a
place of the rarest term are tried, so which term that is makes no difference.

Test sets over ``BLOCK_WORDS`` words are searched in blocks, so what a task holds
does not grow with them; a further block returns only its hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import require_columns
from . import words as W
from .scratch import materialise

WINDOW = 10
SEGMENT_BYTES = 1 << 20     # text of one segment; a longer document is a segment of its own
BLOCK_WORDS = 400_000       # test words broadcast at once
GAP = 64                    # free places between documents, more than any slop
_CANDIDATES = 1 << 20       # starts intersected at once

INDEX = "segment long, doc_ids binary, n_words binary, terms binary, heads binary, positions binary"
MATCHES = ("segment long, row int, doc_id long, n_words long, items array<long>, span_starts array<long>, "
           "span_ends array<long>")


def _segments(terms: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in W.chunks(batches, "text", SEGMENT_BYTES):
            n = b.num_rows
            row, _, _, h = W.split_words(*W.utf8(b.column("text")), "alnum")
            count = np.bincount(row, minlength=n)
            place = np.arange(len(row)) + row * GAP
            if terms is not None and len(terms):
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                keep = terms[at] == h
                h, place = h[keep], place[keep]
            order = np.argsort(h, kind="stable")
            h, place = h[order], place[order]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else order
            one = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), one(b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)),
                 one(count.astype(np.int32)), one(h[head]), one(np.append(head, len(h)).astype(np.int32)),
                 one(place.astype(np.int32))],
                names=["segment", "doc_ids", "n_words", "terms", "heads", "positions"])
            segment += 1
    return run


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """The stored segments of ``docs`` (doc_id long, text); ``terms`` (sorted hashes)
    restricts the postings to words that some test item holds."""
    return materialise(docs.mapInArrow(_segments(terms), INDEX))


def windows(items: list[tuple[int, np.ndarray]], size: int = WINDOW):
    """(item, first rows x size matrix of term hashes, lengths): every run of ``size``
    words; an item of fewer words, but not none, is one window."""
    owner, rows, length = [], [], []
    for item, h in items:
        m = min(size, len(h))
        for i in range(len(h) - m + 1 if m else 0):
            owner.append(item)
            rows.append(np.append(h[i:i + m], np.zeros(size - m, np.uint64)))
            length.append(m)
    return (np.array(owner, np.int64), np.array(rows, np.uint64).reshape(len(rows), size),
            np.array(length, np.int64))


def find(terms, heads, places, win, length, slop: int = 0):
    """(window, start) of all matches in one segment's postings. With ``slop`` a start may
    lie between documents; the caller knows where they begin and end."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(win):
        return none
    at = np.minimum(np.searchsorted(terms, win), len(terms) - 1)
    inside = np.arange(win.shape[1]) < length[:, None]
    known = terms[at] == win
    alive = np.flatnonzero((known | ~inside).all(axis=1))
    if not len(alive):
        return none
    span = int(places.max()) + win.shape[1] + GAP + 1
    keys = np.repeat(np.arange(len(terms)), np.diff(heads)) * span + places
    at, inside = at[alive], inside[alive]
    count = np.where(inside, np.diff(heads)[at], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    rarest = np.take_along_axis(at, order[:, :1], 1)[:, 0]
    todo = count.min(axis=1) * (2 * slop + 1)
    part = np.cumsum(todo) // _CANDIDATES
    found_w, found_s = [], []
    for p in np.unique(part):
        w = np.flatnonzero(part == p)
        n = todo[w]
        who = np.repeat(w, n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        start = places[heads[rarest[who]] + step // (2 * slop + 1)] - order[who, 0] + step % (2 * slop + 1) - slop
        ok = start >= 0
        who, start = who[ok], start[ok]
        for r in range(1, win.shape[1]):
            off = order[who, r]
            free = ~inside[who, off]
            base = at[who, off] * span
            low = base + np.maximum(start + off - slop, 0)
            i = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            ok = free | ((keys[i] >= low) & (keys[i] <= base + start + off + slop))
            who, start = who[ok], start[ok]
            if not len(who):
                break
        found_w.append(alive[who])
        found_s.append(start)
    w, s = np.concatenate(found_w), np.concatenate(found_s)
    if slop:  # one start may be near several places of the rarest term
        w, s = np.unique(np.stack([w, s], axis=1), axis=0).T
    return w, s


def _matches(held, slop: int, hits_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, win, length = held.value
        for b in batches:
            for seg in b.to_pylist():
                ids = np.frombuffer(seg["doc_ids"], np.int64)
                n_words, heads, places = (np.frombuffer(seg[c], np.int32).astype(np.int64)
                                          for c in ("n_words", "heads", "positions"))
                w, start = find(np.frombuffer(seg["terms"], np.uint64), heads, places, win, length, slop)
                base = np.append(0, np.cumsum(n_words + GAP))
                # a row's words start behind the gaps of the rows before it
                doc = np.searchsorted(base, start, side="right") - 1
                ok = start - base[doc] < np.append(n_words, 0)[doc]
                w, start, doc = w[ok], start[ok], doc[ok]
                items = [[] for _ in ids]
                pairs = np.unique(np.stack([doc, owner[w]], axis=1), axis=0) if len(w) else np.zeros((0, 2), np.int64)
                for d, i in pairs.tolist():
                    items[d].append(i)
                starts, ends = [[] for _ in ids], [[] for _ in ids]
                if len(w):
                    last = np.minimum(start + length[w], base[doc] + n_words[doc])
                    order = np.lexsort((last, start))
                    for d, s, e in zip(doc[order].tolist(), (start - base[doc])[order].tolist(),
                                       (last - base[doc])[order].tolist()):
                        if ends[d] and s <= ends[d][-1]:
                            ends[d][-1] = max(ends[d][-1], e)
                        else:
                            starts[d].append(s)
                            ends[d].append(e)
                longs = pa.list_(pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), seg["segment"], np.int64)), pa.array(np.arange(len(ids), dtype=np.int32)),
                     pa.array(ids), pa.array(n_words), pa.array(items, longs), pa.array(starts, longs),
                     pa.array(ends, longs)],
                    names=["segment", "row", "doc_id", "n_words", "items", "span_starts", "span_ends"])
                yield out.filter(pa.array([bool(x) for x in items])) if hits_only else out
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.chunks(batches, "text"):
        row, _, _, h = W.split_words(*W.utf8(b.column("text")), "alnum")
        yield pa.RecordBatch.from_arrays(
            [b.column("item_id"), pa.array(np.bincount(row, minlength=b.num_rows)), W.blobs(h, W.ptr(row, b.num_rows))],
            names=["item_id", "n", "words"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a
    window), items (ids of items with an occurring window, ascending), span_starts and
    span_ends (word ranges of the matches, disjoint, ascending).

    Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. Null
    and empty texts have no words and match nothing; null or wordless items match
    nothing; repeated items each count. Every row with an id is a document of its own, rows
    of the same id too; rows with a null id are left out. Other columns are ignored.
    ``slop`` and ``window`` together must not exceed the gap between documents."""
    if not 0 <= slop <= GAP - window:
        raise ValueError(f"slop {slop}: 0 to {GAP - window}, for windows of {window} words")
    require_columns(docs, [id_col, text_col], "contamination documents")
    require_columns(benchmark, [item_col, text_col], "contamination benchmark")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null")
    items = materialise(benchmark.select(F.col(item_col).cast("long").alias("item_id"),
                                         F.col(text_col).cast("string").alias("text"))
                        .where("item_id is not null").mapInArrow(_item_words, "item_id long, n long, words binary"))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    sc = docs.sparkSession.sparkContext

    def block(i):  # at most about BLOCK_WORDS words, or one item
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).select("item_id", "words").collect()
        return [(r[0], np.frombuffer(r[1], np.uint64)) for r in rows]

    first = block(0)
    terms = np.unique(np.concatenate([h for _, h in first])) if blocks == 1 and total else None
    index = build_index(src, terms)
    parts = []
    for i in range(blocks):
        held = sc.broadcast(windows(first if i == 0 else block(i), window))
        parts.append(index.mapInArrow(_matches(held, slop, i > 0), MATCHES))
    found = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            found = found.unionAll(part)
        spans = F.arrays_zip("span_starts", "span_ends")
        # only what several blocks say of one row is put together; the first block says something of every row
        found = found.groupBy("segment", "row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))
        # join overlapping ranges of different blocks
        joined = F.aggregate("spans", F.array().cast("array<struct<span_starts:bigint,span_ends:bigint>>"), lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["span_starts"] <= F.element_at(acc, -1)["span_ends"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["span_starts"].alias("span_starts"),
                F.greatest(F.element_at(acc, -1)["span_ends"], s["span_ends"]).alias("span_ends")))))
            .otherwise(F.concat(acc, F.array(s))))
        found = found.withColumn("spans", joined).select(
            "doc_id", "n_words", "items", F.col("spans.span_starts").alias("span_starts"),
            F.col("spans.span_ends").alias("span_ends"))
    hit = F.aggregate(F.zip_with("span_ends", "span_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "span_starts", "span_ends")
