"""Language identification by prediction by partial matching (PPM).

For each language the bytes of sample texts give a context tree: for every context of
up to ``ORDER`` bytes the counts of the byte that follows. The code length of a byte
is that of method C: in the longest known context it is coded by its count, or an
escape is paid and the next shorter context tried, down to the uniform code. The
statistics are frozen, so the price of a byte in its context is a constant: the tree
is stored as one table of priced grams per order, with the escape prices of contexts
for grams that no language knows. Scoring a text is a sum of looked-up prices, exact
and without a shuffle; the language of the shortest code wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import require_columns
from . import words as W
from .scratch import materialise

ORDER = 4
PER_LANGUAGE = 300   # distinct sample texts of a language, about
MAX_LANGUAGES = 1_000
MODEL_BYTES = 1 << 30   # of prices, in the driver and every worker
STEP = 16            # languages priced at once
UNKNOWN = "und"
_PAD = 0x20          # stands before a text


class Lookup:
    """Open-addressing table from distinct keys to their positions."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.at[slot] < 0
            self.at[slot[free]] = rest[free]
            done = self.at[slot] == rest
            self.key[slot[done]] = keys[rest[done]]
            rest, slot = rest[~done], (slot[~done] + 1) & (len(self.at) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is not in the table."""
        slot = self._slot(keys)
        out = self.at[slot]
        rest = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.at) - 1)
            found = self.at[slot]
            out[rest] = found
            go = (found >= 0) & (self.key[slot] != keys[rest])
            rest, slot = rest[go], slot[go]
        return out


def grams(data: np.ndarray, off: np.ndarray):
    """(text number, gram) of each byte: the byte in its context of ORDER bytes, packed
    with the byte lowest. ASCII capitals are folded; ORDER pads stand before a text."""
    low = W._LOWER[data]
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(low)) + (row + 1) * ORDER
    padded = np.full(len(low) + len(size) * ORDER + ORDER, _PAD, np.uint64)
    padded[place] = low
    g = padded[place]
    for k in range(1, ORDER + 1):
        g |= padded[place - k] << np.uint64(8 * k)
    return row, g


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram of full order, n) of sample texts."""
    for b in W.chunks(batches, "text"):
        row, g = grams(*W.utf8(b.column("text")))
        langs, code = np.unique(np.array(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        for i, lang in enumerate(langs.tolist()):
            key, n = np.unique(g[code[row] == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)],
                                             names=["lang", "gram", "n"])


def _check_size(languages: int, grams_: int) -> None:
    cells = (ORDER + 1) * languages * grams_     # at most, as no order has more grams than the highest
    if cells * 4 > MODEL_BYTES:
        raise ValueError(f"{languages} languages with {grams_} different grams: up to {cells * 4} bytes of prices in every "
                         f"worker, at most {MODEL_BYTES} allowed; take fewer sample texts per language")


def price(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """Code lengths in bits from full-order gram counts (lang: index of the language). The
    tables have 4 bytes for every gram and language; languages are priced ``STEP`` at a
    time, so that no other array is larger."""
    k = len(languages)
    shape = []
    for order in range(ORDER + 1):
        key, at = np.unique(gram & _mask(order), return_inverse=True)
        context, of = np.unique(key >> np.uint64(8), return_inverse=True)
        shape.append((key, at, context, of))
    tables = [(key, np.empty((len(key), k), np.float32), context, np.empty((len(context), k), np.float32))
              for key, _, context, _ in shape]
    for lo in range(0, k, STEP):
        hi = min(lo + STEP, k)
        mine = (lang >= lo) & (lang < hi)
        below = np.zeros((0, hi - lo))
        for order, (key, at, context, of) in enumerate(shape):
            count = np.zeros((len(key), hi - lo))
            np.add.at(count, (at[mine], lang[mine] - lo), n[mine])
            total, kinds = np.zeros((len(context), hi - lo)), np.zeros((len(context), hi - lo))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(count / (total + kinds)[of])
            lower = np.full((len(key), hi - lo), 8.0) if order == 0 else below[
                np.searchsorted(shape[order - 1][0], key & _mask(order - 1))]
            below = np.where(count > 0, own, escape[of] + lower)
            tables[order][1][:, lo:hi], tables[order][3][:, lo:hi] = below, escape
    return {"languages": languages, "orders": tables}


class Model:
    def __init__(self, priced: dict):
        self.languages = priced["languages"]
        self.orders = [(Lookup(k), b, Lookup(c), e) for k, b, c, e in priced["orders"]]

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of every byte (rows) in every language (columns)."""
        out = np.zeros((len(g), len(self.languages)), np.float32)
        rest = np.arange(len(g))
        for order in range(ORDER, -1, -1):
            table, bits, contexts, escape = self.orders[order]
            key = g[rest] & _mask(order)
            at = table.get(key)
            hit = at >= 0
            out[rest[hit]] += bits[at[hit]]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                return out
            at = contexts.get(key >> np.uint64(8))
            known = at >= 0
            out[rest[known]] += escape[at[known]]
        out[rest] += 8.0
        return out

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of every text (rows) in every language (columns)."""
        row, g = grams(data, off)
        total = np.zeros((len(off) - 1, len(self.languages)))
        for lo in range(0, len(g), 1 << 19):
            part = self.bits(g[lo:lo + (1 << 19)])
            r = row[lo:lo + (1 << 19)]
            head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            total[r[head]] += np.add.reduceat(part, head, axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """Price tables from about ``per_language`` distinct texts of each non-null value of
    ``lang_col`` (a share by a hash of the text, so copies count once and every run
    takes the same). Null and empty texts teach nothing. More than ``MAX_LANGUAGES`` values
    (a dirty column), or a model beyond ``MODEL_BYTES``, raise before they reach the driver."""
    require_columns(docs, [text_col, lang_col], "language fit")
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        "lang is not null and text <> ''").withColumn("name", F.xxhash64("text"))
    names = materialise(src.select("lang", "name").distinct())
    sizes = {r[0]: r[1] for r in names.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different values in {lang_col!r}: no column of languages")
    if not sizes:
        return price([], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    taken = names.where(F.pmod(F.xxhash64("name"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # about per_language names for each language, so it may be broadcast
    sample = src.join(F.broadcast(taken), ["lang", "name"]).groupBy("lang", "name").agg(F.first("text").alias("text"))
    counts = materialise(sample.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long")
                         .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # sized before anything but a number reaches the driver
    _check_size(len(sizes), counts.agg(F.countDistinct("gram")).first()[0])
    t = counts.toArrow()
    languages = sorted(sizes)
    code = {x: i for i, x in enumerate(languages)}
    lang = np.array([code[x] for x in t["lang"].to_pylist()], np.int64)
    return price(languages, lang, t["gram"].to_numpy().view(np.uint64), t["n"].to_numpy())


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep=None) -> DataFrame:
    """``docs`` with lang_pred and score (the posterior share of the shortest code); they
    replace columns of the same name, ``keep`` names the columns that go through.

    Null texts, texts without a letter, and every text under a model without languages
    get ``und`` and score 0. Ties go to the first language in order of name."""
    require_columns(docs, [text_col], "language prediction")
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    out = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()),
                                                          T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    src, column = W.with_text(docs, names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(held.value)
        for b in W.chunks(batches, column):
            data, off = W.utf8(b.column(column))
            n = b.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            seen = np.append(0, np.cumsum(_LETTER[data]))[off]
            letters = seen[1:] > seen[:-1]
            for i in np.flatnonzero(~letters & (off[1:] > off[:-1])).tolist():
                letters[i] = any(map(str.isalpha, b.column(column)[i].as_py()))
            if m.languages and letters.any():
                bits = m.lengths(data, off)
                best = bits.argmin(axis=1)
                rest = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                lang[letters] = np.array(m.languages, object)[best[letters]]
                score[letters] = 1 / rest[letters]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    return src.mapInArrow(run, out)
