"""Product codes of vectors with exact integer codebooks.

Vectors become integers (``floor(scale * x)``) and are cut into equal parts. The parts of
one position are sorted along a Hilbert curve and packed in flat blocks; a block stores
the box of its points (least and greatest component), their sum and the points. Each
round compares boxes with the codebook: an entry whose least distance to the box exceeds
the smallest greatest distance of any entry cannot be nearest to a point inside, so a
short list remains. A list of one gives the whole block from its sum; otherwise the
points are compared with the listed entries in 64-bit integers. Only counts and sums by
entry leave a task, and only codebooks (parts x entries) reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded, require_columns
from . import words as W
from .scratch import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_POINTS = 256
KEY_BITS, KEY_DIMS = 63, 21   # a Hilbert key: at most so many bits, of so many leading components
LABELS = 1_000_000            # label totals are broadcast up to so many rows


class Codes(NamedTuple):
    rows: DataFrame          # vec_id, label, code, error
    codebooks: np.ndarray    # parts x entries x components of a part, int64


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``points`` (n x d, 0 <= value < 2^bits, d * bits <= 63) along
    the Hilbert curve of its grid: the axes are turned level by level, the Gray code is
    undone and the bits are interleaved."""
    x = np.ascontiguousarray(points.T, np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            high = (x[i] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level & 1)
    return key


def short_lists(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(boxes x entries) whether an entry may be nearest, ties included, to a point of a box."""
    a, b = lo[:, None, :] - book[None], book[None] - hi[:, None, :]
    least = np.square(np.maximum(np.maximum(a, b), 0)).sum(2)
    most = np.square(np.maximum(np.abs(a), np.abs(b))).sum(2)
    return least <= most.min(1, keepdims=True)


def nearest(points: np.ndarray, book: np.ndarray, listed: np.ndarray):
    """(entry, squared distance) of the nearest of the ``listed`` entries (ascending), of
    equal ones the first."""
    d = np.square(points[:, None, :] - book[listed][None]).sum(2)
    best = d.argmin(1)
    return listed[best], d[np.arange(len(d)), best]


def next_codebook(book: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entries replaced by the componentwise floor of their mean; unused ones stay."""
    return np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], book)


def codebook_text(books: np.ndarray) -> str:
    """All components in decimal by part, entry and position, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform(v, lambda x: F.floor(x * scale).cast("int"))  # beyond 32 bits the job fails
    return materialise(vectors.where(v.isNotNull() & (F.size(v) > 0) & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"), ints.alias("ints")))


def _seeds(kept: DataFrame, entries: int) -> np.ndarray:
    """Vectors of the smallest ids, ascending; of repeated ids the least vector."""
    found: dict[int, list[int]] = {}
    left = kept.where("vec_id is not null").select("vec_id", "ints")
    while len(found) < entries:
        rows = left.orderBy("vec_id", "ints").limit(entries - len(found)).collect()
        if not rows:
            break
        for r in rows:
            found.setdefault(r.vec_id, r.ints)
        left = left.where(F.col("vec_id") > rows[-1].vec_id)
    return np.array([found[i] for i in sorted(found)], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _cut(parts: int, width: int, low: int, shift: int, bits: int, dims: int):
    """Rows (part, key, row, point) of integer vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                m = _matrix(b.column("ints"), parts * width)
                for p in range(parts):
                    x = np.ascontiguousarray(m[:, p * width:(p + 1) * width])
                    key = hilbert_key((x[:, :dims] - low) >> shift, bits)
                    points = W.blobs(x.astype(np.int32).ravel(), np.arange(len(x) + 1) * width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p, np.int32)), pa.array(key), b.column("row"), points],
                        names=["part", "key", "row", "point"])
    return run


def _pack(width: int, size: int):
    """Blocks of at most ``size`` consecutive points of one part."""
    def block(part: int, rows: np.ndarray, x: np.ndarray) -> list:
        wide = x.astype(np.int64)
        return [part, len(x), x.min(0).tobytes(), x.max(0).tobytes(), wide.sum(0).tobytes(), x.tobytes(), rows.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, x = -1, np.zeros(0, np.int64), np.zeros((0, width), np.int32)
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        names = ["part", "n", "lo", "hi", "total", "points", "rows"]
        for b in batches:
            out = []
            own = b.column("part").to_numpy()
            point = W.unblob(b.column("point"), np.int32)[0].reshape(-1, width)
            row = b.column("row").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, z in zip(edge[:-1], edge[1:]):
                if a == z:
                    continue
                if own[a] != part:
                    if len(rows):
                        out.append(block(part, rows, x))
                    part, rows, x = int(own[a]), rows[:0], x[:0]
                rows, x = np.concatenate([rows, row[a:z]]), np.concatenate([x, point[a:z]])
                full = len(rows) // size * size
                out += [block(part, rows[i:i + size], x[i:i + size]) for i in range(0, full, size)]
                rows, x = rows[full:], x[full:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block(part, rows, x), kinds)], names=names)
    return run


def _boxes(b: pa.RecordBatch, width: int):
    return [W.unblob(b.column(c), kind)[0].astype(np.int64).reshape(-1, width)
            for c, kind in (("lo", np.int32), ("hi", np.int32), ("total", np.int64))]


def _tally(books: np.ndarray):
    """(part, entry, count, sums) of all points of a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                part, n = b.column("part").to_numpy(), b.column("n").to_numpy()
                lo, hi, sums = _boxes(b, width)
                points, off = W.unblob(b.column("points"), np.int32)
                for p in np.unique(part):
                    mine = np.flatnonzero(part == p)
                    listed = short_lists(lo[mine], hi[mine], books[p])
                    one = listed.sum(1) == 1
                    entry = listed[one].argmax(1)
                    np.add.at(count[p], entry, n[mine[one]])
                    np.add.at(total[p], entry, sums[mine[one]])
                    for i, row in zip(mine[~one], listed[~one]):
                        x = points[off[i]:off[i + 1]].astype(np.int64).reshape(-1, width)
                        got = nearest(x, books[p], np.flatnonzero(row))[0]
                        count[p] += np.bincount(got, minlength=entries)
                        np.add.at(total[p], got, x)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
             pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _assign(books: np.ndarray):
    """(row, part, entry, distance) of every point."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                part = b.column("part").to_numpy()
                lo, hi, _ = _boxes(b, width)
                points, off = W.unblob(b.column("points"), np.int32)
                out = []
                for i, p in enumerate(part):
                    x = points[off[i]:off[i + 1]].astype(np.int64).reshape(-1, width)
                    listed = np.flatnonzero(short_lists(lo[i:i + 1], hi[i:i + 1], books[p])[0])
                    out.append((np.full(len(x), p, np.int32), *nearest(x, books[p], listed)))
                part, entry, far = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.unblob(b.column("rows"), np.int64)[0]), pa.array(part), pa.array(entry.astype(np.int32)),
                     pa.array(far)], names=["row", "part", "entry", "far"])
    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors: rows (vec_id, label, code, error) and the final codebooks.

    Codebooks start as the parts of the ``entries`` smallest ids (fewer if there are
    fewer), ascending; of rows with the same id the least vector counts. Rounds and the
    final assignment go by squared Euclidean distance of the integers, ties to the lower
    entry. ``code`` has two hex digits a part, ``error`` is the sum of the distances.

    Rows whose vector is null, empty or holds null or non-finite components are dropped;
    any other row, repeated ones too, has a row of its own. A row with a null id is
    coded, but starts no codebook; if all ids are null, there is no codebook and the
    job fails. An empty table gives no rows and empty codebooks. Vectors of unequal
    dimension, of one that ``parts`` does not divide, or too large for exact 64-bit
    distances fail the job. Other columns are ignored."""
    require_columns(vectors, [id_col, vector_col, label_col], "compress")
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256, as a part has two hex digits")
    kept = _integers(vectors, id_col, vector_col, label_col, scale)
    seen = kept.agg(F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most"),
                    F.min(F.array_min("ints")).alias("lo"), F.max(F.array_max("ints")).alias("hi")).first()
    if seen.least is None:
        return Codes(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")),
                     np.zeros((parts, 0, 0), np.int64))
    if seen.least != seen.most or seen.most % parts:
        raise ValueError(f"dimensions {seen.least} to {seen.most}: must be equal and a multiple of {parts}")
    width = seen.most // parts
    if (seen.hi - seen.lo) ** 2 * seen.most >= 1 << 63:
        raise ValueError("components too large for exact distances")
    first = _seeds(kept, entries)
    if not len(first):
        raise ValueError("no vector has an id to start a codebook from")
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2)

    dims = min(width, KEY_DIMS)
    spread = max((seen.hi - seen.lo).bit_length(), 1)
    bits = min(KEY_BITS // dims, spread)
    shift = spread - bits
    dealt = kept.select("row", "ints").mapInArrow(_cut(parts, width, seen.lo, shift, bits, dims),
                                                  "part int, key long, row long, point binary")
    order = ["part", "key", "row"]  # the row number splits a group of equal points
    blocks = materialise(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack(width, BLOCK_POINTS),
        "part int, n long, lo binary, hi binary, total binary, points binary, rows binary"))
    for _ in range(rounds):
        got = (blocks.drop("rows").mapInArrow(_tally(books), "part int, entry int, n long, sums array<long>")
               .groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]) for i in range(width)]))
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for r in got.collect():  # at most parts x entries rows
            count[r[0], r[1]], total[r[0], r[1]] = r[2], r[3:]
        books = next_codebook(books, count, total)
    entry = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    codes = (blocks.select("part", "lo", "hi", "total", "points", "rows")
             .mapInArrow(_assign(books), "row long, part int, entry int, far long")
             .groupBy("row").agg(F.concat(*entry).alias("code"), F.sum("far").alias("error")))
    return Codes(kept.select("row", "vec_id", "label").join(codes, "row").drop("row"), books)


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` and label_error: the error summed over rows of the same label, null with null."""
    codes = materialise(codes)
    total = codes.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return codes.join(broadcast_if_bounded(materialise(total), LABELS), F.col("label").eqNullSafe(F.col("own"))).drop("own")


def restore(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """``codes`` with ``restored`` array<double>: the entries that a code names, scaled
    back. A null code gives a null vector."""
    parts = len(codebooks)
    books = F.array(*[F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in b]) for b in codebooks.tolist()])
    entry = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    whole = F.concat(*[F.get(books[p], entry[p]) for p in range(parts)])
    return codes.withColumn("restored", F.when(F.col(code_col).isNotNull(), whole))
