"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a column slice: no Python string per
word is ever made. Both word definitions of this package split at ASCII bytes
only, so bytes and code points give the same words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once; the numpy temporaries are about 50 times that.
CHUNK_BYTES = 1 << 19

_ALNUM = np.zeros(256, bool)          # words [0-9a-z] and every byte from 0x80
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_SOLID = np.ones(256, bool)           # words of anything but ASCII white space
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
KINDS = {"alnum": _ALNUM, "solid": _SOLID}

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every input bit reaches every output bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(batches, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``max_bytes`` of text; one longer
    text is a slice of its own."""
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(lens):
            continue
        part = np.cumsum(lens, dtype=np.int64) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        at = [0, *cuts.tolist(), len(lens)]
        for a, b in zip(at[:-1], at[1:]):
            yield batch.slice(a, b - a)


def free_name(taken, name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it in any case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame, names: list[str], text_col: str) -> tuple[DataFrame, str]:
    """Columns ``names`` of ``docs`` and the text as a string, and the name that it has: a
    kept string column is not sent to Python twice."""
    if text_col in names and docs.schema[text_col].dataType.simpleString() == "string":
        return docs.select(*names), text_col
    own = free_name(names, "__text")
    return docs.select(*names, F.col(text_col).cast("string").alias(own)), own


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def split_words(data: np.ndarray, off: np.ndarray, kind: str, lower: bool = True, cut: np.ndarray | None = None):
    """(row, start, length, hash) of every word, in text order; ``cut`` marks bytes of
    words at which another word begins."""
    low = _LOWER[data] if lower else data
    solid = KINDS[kind][low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    if cut is not None:
        first |= cut & solid
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = solid[heads]
    start = np.flatnonzero(first)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    at = np.flatnonzero(solid)
    head = first[at]
    word = np.cumsum(head) - 1
    pos = at - start[word]
    begin = np.flatnonzero(head)
    length = np.diff(np.append(begin, len(at)))
    val = _BYTE[low[at]] * powers(_P, int(pos.max()) + 1)[pos]
    h = np.add.reduceat(val, begin)
    row = np.searchsorted(off, start, side="right") - 1
    return row, start, length, mix(h + length.astype(np.uint64))


def shingles(row: np.ndarray, h: np.ndarray, k: int):
    """(row, hash) of all runs of ``k`` words in one row; a row of fewer words
    (not none) gives its whole run as one. Rows ascend; repeats are kept."""
    n = len(h)
    if not n:
        return row, h
    acc = np.zeros(n, np.uint64)
    pw = powers(_Q, k)
    for i in range(min(k, n)):
        acc[:n - i] += h[i:] * pw[i]
    full = np.zeros(n, bool)
    if n >= k:
        full[:n - k + 1] = row[:n - k + 1] == row[k - 1:]
    out_row, out = row[full], mix(acc[full])
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(heads, n))
    short = size < k
    if short.any():
        s, m = heads[short], size[short]
        acc = np.zeros(len(s), np.uint64)
        for i in range(k - 1):
            has = m > i
            acc[has] += h[s[has] + i] * pw[i]
        out_row = np.concatenate([out_row, row[s]])
        out = np.concatenate([out, mix(acc + m.astype(np.uint64) * _P)])
        order = np.argsort(out_row, kind="stable")
        out_row, out = out_row[order], out[order]
    return out_row, out


def distinct(row: np.ndarray, h: np.ndarray):
    """Distinct (row, hash), sorted by both."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return row[keep], h[keep]


def ptr(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of ``n`` rows in an ascending row column."""
    return np.searchsorted(row, np.arange(n + 1))


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the bytes of values[at[i]:at[i + 1]]."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize
    off = (at - at[0]).astype(np.int64) * size
    raw = pa.py_buffer(values[at[0]:at[-1]].tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1,
                                 [None, pa.py_buffer(off.tobytes()), raw]).cast(pa.binary())


def unblob(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``blobs``: (values, offsets)."""
    column = column.cast(pa.large_binary())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    buf = column.buffers()[2]
    raw = buf.to_pybytes()[off[0]:off[-1]] if buf is not None else b""
    return np.frombuffer(raw, dtype), (off - off[0]) // np.dtype(dtype).itemsize
