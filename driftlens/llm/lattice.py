"""Embedding near-duplicates by E8 lattice hashing.

A table projects the unit vectors on ``BLOCKS`` random orthonormal frames of eight
dimensions and decodes each projection to its nearest point of the scaled E8 lattice;
the points together name a cell. A vector is stored in its own cell and probes
neighbouring ones: per block it may step to the lattice points next nearest to its
projection. Two vectors meet in a table if either is stored in a cell that the other
visits.

Cells with several visitors are dealt in blocks of bounded size; a task sees two blocks
and multiplies them in double precision. A pair may meet in many tables and cells: it
counts only where both agree that it is its first meeting, which they tell from the
cells that each vector carries, so link counts need no pair table. Only counts and
spanning links leave a task: a group of n vectors costs O(n) rows per block pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded, require_columns
from . import words as W
from .graph import connected_components
from .scratch import materialise

TABLES, BLOCKS, SCALE = 28, 2, 0.28  # a pair at cosine 0.9 misses every table with probability 2e-5
BLOCK_ROWS = 512
SEED = 20240607


@lru_cache(maxsize=4)
def frames(dim: int, tables: int, blocks: int, seed: int = SEED) -> np.ndarray:
    """tables x blocks x dim x 8 random frames with orthonormal columns (for fewer than
    eight dimensions: random directions), scaled to keep the mean squared length."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.empty((tables, blocks, dim, 8))
    for t in range(tables):
        for b in range(blocks):
            q = rng.standard_normal((dim, 8))
            out[t, b] = np.linalg.qr(q)[0] if dim >= 8 else q / np.sqrt(dim)
    return out * np.sqrt(dim / 64.0)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    gap = x - near
    worst = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    w = worst[rows]
    near[rows, w] += np.where(gap[rows, w] < 0, -1, 1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of n x 8 reals, in doubled coordinates (E8 is D8 and D8 shifted
    by one half)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    far = ((x - a) ** 2).sum(axis=1) > ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(far[:, None], b, a)).astype(np.int64)


def step(rest: np.ndarray) -> np.ndarray:
    """The shortest lattice vector (doubled coordinates) that leads to the point next
    nearest to a projection, given what is left of it after decoding. Of the 240, half
    the signs with an even number of minus, or two units, has the largest product."""
    n = np.arange(len(rest))
    size, sign = np.abs(rest), np.where(rest < 0, -1, 1)
    order = np.argsort(-size, axis=1, kind="stable")
    i, j, last = order[:, 0], order[:, 1], order[:, 7]
    odd = (sign < 0).sum(axis=1) & 1
    halves = sign.copy()
    halves[n, last] *= 1 - 2 * odd
    units = np.zeros_like(sign)
    units[n, i], units[n, j] = 2 * sign[n, i], 2 * sign[n, j]
    better = size.sum(axis=1) / 2 - odd * size[n, last] > size[n, i] + size[n, j]
    return np.where(better[:, None], halves, units)


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit names of lattice points."""
    h = np.full(points.shape[:-1], salt * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(8):
        h = W.mix(h + points[..., i].astype(np.int64).view(np.uint64))
    return h


def cells(v: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """n x tables x visits cell names of unit vectors. The first visit is the vector's
    own cell; the others step to the next nearest lattice point in one or two blocks."""
    n, dim = v.shape
    out = np.empty((n, tables, 1 + BLOCKS + BLOCKS * (BLOCKS - 1) // 2), np.uint64)
    for t, table in enumerate(frames(dim, tables, BLOCKS)):
        total, move = np.zeros(n, np.uint64), []
        for b, frame in enumerate(table):
            x = v @ frame / SCALE
            own = decode(x)
            near = own + step(x - own / 2)
            name = _name(own, t * BLOCKS + b + 1)
            total += name
            move.append(_name(near, t * BLOCKS + b + 1) - name)
        visits = [total] + [total + m for m in move]
        visits += [total + move[i] + move[j] for i in range(BLOCKS) for j in range(i)]
        out[:, t] = W.mix(np.stack(visits, axis=1))
    return out


def _normed(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def unit(column: pa.Array):
    """(row numbers, unit vectors, dimensions, components as given) of the usable
    vectors: not null, not zero, no null or non-finite component. Shorter rows are
    padded with zeros."""
    n = len(column)
    size = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    holes = np.array(flat.is_null().to_numpy(zero_copy_only=False), bool)
    values = np.array(flat.fill_null(0).to_numpy(zero_copy_only=False))
    at = np.append(0, np.cumsum(size))
    v = np.zeros((n, int(size.max()) if n else 0), values.dtype)
    row = np.repeat(np.arange(n), size)
    v[row, np.arange(len(values)) - at[row]] = values
    bad = np.zeros(n, bool)
    bad[row[holes | ~np.isfinite(values)]] = True
    v[bad] = 0
    ok = np.flatnonzero((v != 0).any(axis=1))
    given = v[ok]
    return ok, _normed(given.astype(float)) if len(ok) else given.astype(float), size[ok], given


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, 128-bit name of the unit vector, the components as given) of the
    usable vectors."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            b = batch.slice(lo, 2048)
            ok, v, size, given = unit(b.column("embedding"))
            ids = b.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)[ok]
            for dim in np.unique(size).tolist():
                w = size == dim
                x = np.ascontiguousarray(v[w, :dim])
                bits = (x + 0.0).view(np.uint64)
                pw = W.powers(W._Q, dim)
                s1 = W.mix((W.mix(bits) * pw).sum(axis=1, dtype=np.uint64))
                s2 = W.mix((W.mix(bits ^ W._P) * pw).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[w]), pa.array(np.full(len(x), dim)), pa.array(s1.view(np.int64)),
                     pa.array(s2.view(np.int64)),
                     W.blobs(np.ascontiguousarray(given[w, :dim]).reshape(-1), np.arange(len(x) + 1) * dim)],
                    names=["vec_id", "dim", "s1", "s2", "v"])


def _by_dim(b: pa.RecordBatch):
    dims, blobs = b.column("dim").to_numpy(), b.column("v")
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        values, _ = W.unblob(blobs.take(pa.array(rows)), np.uint8)
        values = values.reshape(len(rows), -1)
        kind = np.float32 if values.shape[1] == 4 * dim else np.float64
        yield dim, rows, _normed(values.view(kind).astype(float))


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tab, cell, vec_id, stored): the cells that each vector visits."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        for dim, rows, v in _by_dim(batch):
            for lo in range(0, len(rows), 512):
                c = cells(v[lo:lo + 512]) + np.uint64(dim)
                n, t, p = c.shape
                stored = np.zeros((n, t, p), bool)
                stored[:, :, 0] = True
                table = np.broadcast_to(np.arange(t, dtype=np.int32)[None, :, None], c.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table.reshape(-1)), pa.array(c.reshape(-1).view(np.int64)),
                     pa.array(np.repeat(ids[rows[lo:lo + 512]], t * p)), pa.array(stored.reshape(-1))],
                    names=["tab", "cell", "vec_id", "stored"])


def first_meetings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First table in which two vectors meet (n x tables x visits each)."""
    meet = ((a == b[:, :, :1]).any(axis=2)) | ((b == a[:, :, :1]).any(axis=2))
    return meet.argmax(axis=1)


def _pairs(size: np.ndarray):
    """(i, j) with i < j of all pairs inside consecutive groups of the given sizes."""
    ahead = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    j = np.repeat(np.arange(len(ahead)), ahead)
    return j - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(ahead) - ahead, ahead)), j


def close_pairs(v, stored, side, group, limit: float, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group with cosine >= ``limit`` of which one at least is
    stored. ``side``: a group dealt as two different blocks compares rows of different
    sides only (0 and 1); in any other, all rows have side 2."""
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(head, len(group)))
    out = []
    small = size <= 48
    rows = np.flatnonzero(np.repeat(small, size))
    i, j = _pairs(size[small])
    i, j = rows[i], rows[j]
    ok = (stored[i] | stored[j]) & ((side[i] == 2) | (side[i] != side[j]))
    i, j = i[ok], j[ok]
    for lo in range(0, len(i), step):
        a, b = i[lo:lo + step], j[lo:lo + step]
        hit = np.einsum("ij,ij->i", v[a], v[b]) >= limit
        out.append((a[hit], b[hit]))
    for g in np.flatnonzero(~small).tolist():
        x = np.arange(head[g], head[g] + size[g])
        dots = v[x] @ v[x].T >= limit
        dots &= stored[x][:, None] | stored[x][None, :]
        dots &= (side[x][:, None] == 2) | (side[x][:, None] != side[x][None, :])
        a, b = np.nonzero(np.triu(dots, 1))
        out.append((x[a], x[b]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def counts_here(ids, visits, a, b, stored, table) -> np.ndarray:
    """Does a found pair count in the cell where it was found? It must be its first
    table; there it may meet in the own cell of either row, and counts in that of the
    smaller id if it can."""
    ca, cb = visits(a), visits(b)
    first = first_meetings(ca, cb) == table[a]
    n = np.arange(len(a))
    ca, cb = ca[n, table[a]], cb[n, table[a]]
    swap = ids[a] > ids[b]
    small, large = np.where(swap[:, None], cb, ca), np.where(swap[:, None], ca, cb)
    in_small = (large == small[:, :1]).any(axis=1)
    return first & ((small[:, 0] == large[:, 0]) | (np.where(swap, stored[b], stored[a]) == in_small))


def _links(limit: float):
    """Rows of whole groups, sorted by them -> (vec_id, links, root)."""
    def solve(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, table = b.column("vec_id").to_numpy(), b.column("tab").to_numpy()
        x, y, block = (b.column(c).to_numpy() for c in ("x", "y", "block"))
        stored = np.array(b.column("stored").to_numpy(zero_copy_only=False), bool)
        copies, cell = b.column("copies").to_numpy(), b.column("cell").to_numpy()
        links, root = np.zeros(len(ids), np.int64), ids.copy()
        for _, rows, v in _by_dim(b):
            same = ((cell[rows][1:] == cell[rows][:-1]) & (table[rows][1:] == table[rows][:-1])
                    & (x[rows][1:] == x[rows][:-1]) & (y[rows][1:] == y[rows][:-1]))
            group = np.append(0, np.cumsum(~same))
            side = np.where(x == y, 2, np.where(block == x, 0, 1))[rows]
            p, q = close_pairs(v, stored[rows], side, group, limit)
            if not len(p):
                continue
            # a vector may be here once per cell: its cells are made once
            known, at = np.unique(ids[rows], return_index=True)
            used = np.unique(ids[rows][np.concatenate([p, q])])
            c = cells(v[at[np.searchsorted(known, used)]]) + np.uint64(v.shape[1])
            visits = lambda k: c[np.searchsorted(used, ids[rows][k])]  # noqa: B023, E731
            keep = np.concatenate([counts_here(ids[rows], visits, p[lo:lo + 8192], q[lo:lo + 8192], stored[rows], table[rows])
                                   for lo in range(0, len(p), 8192)])
            p, q = rows[p[keep]], rows[q[keep]]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            while True:  # smallest id reachable over the links seen here
                low = root.copy()
                np.minimum.at(low, p, root[q])
                np.minimum.at(low, q, root[p])
                if (low == root).all():
                    break
                root = low
        seen = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(links[seen]), pa.array(root[seen])],
                                          names=["vec_id", "links", "root"])

    keys = ("tab", "cell", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                b = whole.slice(lo, 8192)
                last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
                tail = np.ones(b.num_rows, bool)
                for k, value in zip(keys, last):
                    tail &= b.column(k).to_numpy() == value
                cut = b.num_rows - int(tail.sum())  # the last group may go on
                if cut:
                    t = pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                    held = []
                    yield from (solve(p) for p in t.to_batches())
                elif held and tuple(held[0].column(k)[0].as_py() for k in keys) != last:
                    yield from (solve(p) for p in pa.Table.from_batches(held).combine_chunks().to_batches())
                    held = []
                held.append(b.slice(cut))
        if held:
            yield from (solve(p) for p in pa.Table.from_batches(held).combine_chunks().to_batches())
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 limit: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of cosine >= ``limit``),
    component_id (smallest id reachable, itself included), kept (vec_id = component_id).

    Null and zero vectors and those with null or non-finite components have no links,
    nor have vectors of different dimensions with each other. Equal vectors link. Ids
    must be unique; a null id is kept with a null component. Other columns are ignored."""
    require_columns(vectors, [id_col, vector_col], "near_vectors")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).alias("embedding"))
    if src.schema["embedding"].dataType.simpleString() != "array<float>":
        src = src.withColumn("embedding", F.col("embedding").cast("array<double>"))
    usable = materialise(src.where("vec_id is not null and embedding is not null").mapInArrow(
        _vectors, "vec_id long, dim long, s1 long, s2 long, v binary"))
    # equal directions are one class, counted with their number
    ident = ["dim", "s1", "s2"]
    classes = materialise(usable.groupBy(*ident).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    same = (usable.select("vec_id", *ident).join(classes.where("copies > 1"), ident)
            .select("vec_id", "rep", "copies"))
    reps = materialise(usable.join(classes.select(F.col("rep").alias("vec_id"), "copies"), "vec_id")
                       .select("vec_id", "copies", "dim", "v"))
    visits = materialise(reps.select("vec_id", "dim", "v").mapInArrow(
        _visits, "tab int, cell long, vec_id long, stored boolean"))
    busy = (visits.groupBy("tab", "cell").agg(F.count("*").alias("n"), F.max("stored").alias("some"))
            .where("n > 1 and some"))
    busy = materialise(busy.select("tab", "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    dealt = (visits.join(broadcast_if_bounded(busy, 1_000_000), ["tab", "cell"])
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("tab", "cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                     "vec_id", "block", "stored"))
    keys = ["tab", "cell", "x", "y"]
    found = materialise(dealt.join(reps, "vec_id").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
                        .mapInArrow(_links(limit), "vec_id long, links long, root long"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = (found.where("root is not null and root <> vec_id").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
             .unionAll(same.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    comp = connected_components(edges)
    reps_links = (classes.select(F.col("rep").alias("r"), "copies")
                  .join(links.withColumnRenamed("vec_id", "r"), "r", "left")
                  .select("r", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0"))
    own = (src.select("vec_id").join(same.select("vec_id", "rep"), "vec_id", "left")
           .withColumn("r", F.coalesce("rep", "vec_id")))
    return (own.join(reps_links, "r", "left").join(comp, F.col("vec_id") == F.col("node"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
