"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q and at least ``max(min_length, 2 q)``
words that no neighbouring word extends. Words are what ASCII white space separates.

The dictionary names every factor of length L = 2^k of a text: two places have the same
name at level k where the same L words follow; level k + 1 names pairs of names. Only
places whose factor occurs again in its text stay, so the levels of ordinary text empty
soon.

Periods q in [L, 2 L) are proposed at the level of L. Occurrences of a factor closer than
L / 2 stand in arithmetic progression (its own period), so a list of occurrences is a
list of progressions more than L / 2 apart, of which at most three begin within 2 L after
any place. The first place of a run meets its image either as the first element of a
later progression, or the last elements of both progressions are q apart; these are the
proposals, a few per place. They are extended both ways by descending the levels, and
runs with the same ends keep their smallest period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..checks import require_columns
from . import words as W

MIN_LENGTH = 12
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _named(key: np.ndarray, place: np.ndarray, n: int):
    """(place, group) of the keys that occur again, by key and place, and a name for
    every one of ``n`` places: a place without a repeated key has a name of its own."""
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    again = np.bincount(group, minlength=1)[group] > 1
    place, group = place[again], group[again]
    names = -1 - np.arange(n, dtype=np.int32)
    names[place] = group
    return place, group, names


def _proposals(place: np.ndarray, group: np.ndarray, size: int):
    """(place, period) with period in [size, 2 size) from the progressions of one level."""
    if len(place) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = (group[1:] != group[:-1]) | (2 * (place[1:] - place[:-1]) > size)
    first = np.append(True, cut)
    mine = np.cumsum(first) - 1
    head, tail, of = place[first], place[np.append(cut, True)], group[first]
    at, period = [], []
    for lag in (1, 2, 3):
        for start, own, target in ((place, mine, head), (tail, np.arange(len(tail)), tail)):
            to = own + lag
            ok = to < len(head)
            ok[ok] = of[to[ok]] == of[own[ok]]
            q = target[to[ok]] - start[ok]
            fits = (q >= size) & (q < 2 * size)
            at.append(start[ok][fits])
            period.append(q[fits])
    return np.concatenate(at), np.concatenate(period)


def word_runs(row: np.ndarray, name: np.ndarray, min_length: int = MIN_LENGTH):
    """(start, end, period) of every run, by start and period. ``row`` (ascending) says
    to which text a word belongs and ``name`` (uint64) which word it is; no run leaves
    its text. Memory is 4 bytes per word and level, with log2(longest repeat) levels."""
    n = len(row)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    end = np.searchsorted(row, row, side="right")
    order = np.lexsort((name, row))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (name[order][1:] != name[order][:-1]))
    key = np.empty(n, np.int64)
    key[order] = np.cumsum(new)
    place, size = np.arange(n), 1
    levels: list[np.ndarray] = []
    at, period = [], []
    while len(place):
        place, group, names = _named(key, place, n)
        if not len(place):
            break
        levels.append(names)
        a, q = _proposals(place, group, size)
        at.append(a)
        period.append(q)
        place = place[place + 2 * size <= end[place]]
        place = np.sort(place[names[place + size] >= 0])
        key = names[place].astype(np.int64) * n + names[place + size]
        size *= 2
    a, q = (np.concatenate(x) if x else none for x in (at, period))
    step = np.unique(q * (n + 1) + a)
    step = step[np.append(True, np.diff(step) != 1)] if len(step) else step  # neighbours are one run
    q, a = step // (n + 1), step % (n + 1)
    s, e = a.copy(), a.copy()
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        ok = e + q + size <= n
        ok[ok] = names[e[ok]] == names[e[ok] + q[ok]]
        e[ok] += size
        ok = s >= size
        ok[ok] = names[s[ok] - size] == names[s[ok] + q[ok] - size]
        s[ok] -= size
    e = e + q
    long = e - s >= np.maximum(min_length, 2 * q)
    s, e, q = s[long], e[long], q[long]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    least = np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])) if len(s) else np.zeros(0, bool)
    s, e, q = s[least], e[least], q[least]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _joined(data: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Strings of ``n`` rows: the words of each, joined by one space."""
    size = length + 1
    to = np.append(0, np.cumsum(size))
    out = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    out[inside] = data[np.repeat(start - (to[:-1] - np.arange(len(start))), length) + np.arange(int(length.sum()))]
    at = np.searchsorted(row, np.arange(n + 1))
    cut = at[1:][at[1:] > at[:-1]]
    inside[:] = True
    inside[to[cut] - 1] = False        # no space after the last word of a row
    total = np.where(np.diff(at) > 0, to[at[1:]] - to[at[:-1]] - 1, 0)
    off = np.append(0, np.cumsum(total))
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(off.astype(np.int64).tobytes()),
                                                        pa.py_buffer(out[inside].tobytes())]).cast(pa.string())


def collapse(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, keep=None) -> DataFrame:
    """``docs`` with n_words long, runs array<struct<start, length, period>> (word numbers
    from 0, by start, then period) and collapsed string: the words that no run holds after
    its first period, joined by one space. The three replace columns of the same name;
    ``keep`` names the columns that go through (all by default).

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are
    independent: repeated rows and null ids are treated like any other, an empty table
    stays empty. A text is handled whole, about half a megabyte of texts at once."""
    require_columns(docs, [text_col], "collapse")
    added = ("n_words", "runs", "collapsed")
    names = [c for c in (keep or docs.columns) if c not in added]
    out = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("collapsed", T.StringType())])
    src, column = W.with_text(docs, names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, column):
            data, off = W.utf8(b.column(column))
            row, start, length, name = W.split_words(data, off, "solid", lower=False)
            s, e, q = word_runs(row, name, min_length)
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            cover = np.zeros(len(row) + 1, np.int64)
            np.add.at(cover, s + q, 1)
            np.add.at(cover, e, -1)
            left = np.cumsum(cover[:-1]) == 0
            of = row[s]
            found = pa.StructArray.from_arrays([pa.array(s - first[of]), pa.array(e - s), pa.array(q)],
                                               names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)),
                                             found)
            text = _joined(data, start[left], length[left], row[left], b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(np.diff(first)), lists, text],
                                             names=[*names, *added])

    return src.mapInArrow(run, out)
