"""Token ids of documents in files that answer questions without being unpacked.

Documents are encoded, dealt into ranges of ascending ids and packed in shards of whole
documents; a shard is one Parquet file of one row, whose ``payload`` is a compressed
wavelet matrix (``wavelet``). Spark's own writer commits the files, so a lost executor
leaves none half written. Questions (documents, counts, occurrences, ids at places) are
jobs over the shards.

Texts are encoded by the library's tokenizer, but every distinct unit only once: its
pattern never matches across white space, nor past the end of a run of ASCII letters or
beside an ASCII digit, so texts can be cut there."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checks import require_columns
from . import words as W
from .wavelet import WaveletMatrix, from_bytes, to_bytes

TOKENIZER, END_ID = "word_bpe_49k.json", 1
SHARD_TOKENS = 1 << 22
KEPT_UNITS, KEPT_IDS = 1 << 20, 1 << 23   # encoded units and their ids kept by a worker; beyond, it starts anew
SHARDS = "part int, before long, n_tokens long, n_documents long, payload binary"

_LETTER, _DIGIT, _SAFE = (np.zeros(256, bool) for _ in range(3))
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _DIGIT[0x30:0x3A] = True
_SAFE[0x21:0x7F] = ~(_LETTER | _DIGIT)[0x21:0x7F]
_SAFE[0x27] = False               # 's and the like are matched as one
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")   # lower case, one match, left alone by NFC
#: A byte of a printing Latin-1 character stands for itself in the vocabulary, the others follow from 256.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_AS_TEXT = {b: 256 + i for i, b in enumerate(_OTHERS)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def unit_cuts(data: np.ndarray) -> np.ndarray:
    """Bytes at which a unit may begin inside a word: the pattern of the tokenizer
    (contractions, letters, single digits, other marks) ends a match before them."""
    plain = data < 0x80
    letter, digit = _LETTER[data], _DIGIT[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & ~letter[1:] | _SAFE[data[:-1]] & letter[1:] | digit[:-1] | digit[1:]) & plain[:-1] & plain[1:]
    return cut


class HashSlots:
    """Numbers of 64-bit hashes by open addressing; at most half of the table is used."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.keys, self.number = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for a new one."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.number[at[hit]]
            on = ~hit & (key != 0)
            left, at = left[on], (at[on] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct new hashes."""
        at = (h & self.mask).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]          # of several for one place the last stays
            mine = self.keys[at] == h
            self.number[at[mine]] = number[mine]
            h, number, at = h[~mine], number[~mine], (at[~mine] + 1) & int(self.mask)


class UnitEncoder:
    """Ids of texts; a unit is known by the 64-bit hash of its lower-cased bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark deals the work
        self.library = Tokenizer.from_file(path)
        self.top = self.library.get_vocab_size() - 1
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.slots = HashSlots(2 * KEPT_UNITS)
        self.units = self.pooled = 0
        self.hashes = np.zeros(KEPT_UNITS, np.uint64)
        self.begin, self.size = np.zeros(KEPT_UNITS, np.int64), np.zeros(KEPT_UNITS, np.int64)
        self.pool = np.zeros(KEPT_IDS, np.uint32)

    def _reserve(self, units: int, ids: int) -> None:
        """Room for more units than are kept for long: a text may hold very many."""
        if units > len(self.begin):
            self.hashes, self.begin, self.size = (np.resize(x, 2 * units) for x in (self.hashes, self.begin, self.size))
        if ids > len(self.pool):
            self.pool = np.resize(self.pool, 2 * ids)
        if 2 * units > len(self.slots.keys):
            self.slots = HashSlots(1 << (4 * units).bit_length())
            self.slots.add(self.hashes[:self.units], np.arange(self.units))

    def _learn(self, units: list[bytes], h: np.ndarray) -> None:
        model, other = self.library.model, []
        ids: list = [None] * len(units)
        for i, u in enumerate(units):
            u = u.lower()
            if u.isalpha():                   # ASCII letters alone
                ids[i] = [t.id for t in model.tokenize(u.decode())]
            elif _LATIN.fullmatch(u):
                ids[i] = [t.id for t in model.tokenize(u.decode("latin-1").translate(_AS_TEXT))]
            else:
                other.append(i)
        for i, e in zip(other, self.library.encode_batch_fast([units[i].decode("utf-8", "replace") for i in other],
                                                              add_special_tokens=False)):
            ids[i] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total, number = int(size.sum()), self.units + np.arange(len(ids))
        self._reserve(self.units + len(ids), self.pooled + total)
        self.hashes[number], self.begin[number], self.size[number] = h, self.pooled + np.cumsum(size) - size, size
        self.pool[self.pooled:self.pooled + total] = np.fromiter((t for x in ids for t in x), np.uint32, total)
        self.slots.add(h, number)
        self.units, self.pooled = self.units + len(ids), self.pooled + total

    def encode(self, data: np.ndarray, off: np.ndarray):
        """(offsets, ids) of the texts that ``off`` cuts out of ``data``."""
        raw = data.tobytes()
        special = any(t in raw for t in self.special)   # then words stay whole, in their own case
        row, start, length, h = W.split_words(data, off, "solid", lower=not special, cut=None if special else unit_cuts(data))
        if special:
            h = W.mix(h)
        h[h == 0] = 1
        if self.units > KEPT_UNITS or self.pooled > KEPT_IDS:
            self._empty()
        unit = self.slots.find(h)
        new = np.flatnonzero(unit < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            at = new[at]
            self._learn([raw[a:b] for a, b in zip(start[at].tolist(), (start[at] + length[at]).tolist())], fresh)
            unit[new] = self.slots.find(h[new])
        size = self.size[unit]
        to = np.append(0, np.cumsum(size))
        ids = self.pool[np.repeat(self.begin[unit] - to[:-1], size) + np.arange(to[-1])]
        return to[np.searchsorted(row, np.arange(len(off)))], ids


def _pack(tokenizer: str, end_id: int | None, shard_tokens: int, kept):
    """One row per shard of the sorted documents of a task. ``kept`` is the broadcast of an
    empty dict: a worker holds its encoder there from one task to the next."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept.value.setdefault("encoder", None) or UnitEncoder(tokenizer)
        kept.value["encoder"] = enc
        digits = max(enc.top, end_id or 0, 1).bit_length()
        kind = np.uint16 if digits <= 16 else np.uint32
        part, before = TaskContext.get().partitionId(), 0
        ids, doc_ids, sizes, held = [], [], [], 0

        def shard():
            x = np.concatenate(ids)
            payload = to_bytes(WaveletMatrix.of(x, digits), doc_ids, np.array(sizes))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before]), pa.array([len(x)]), pa.array([len(sizes)]),
                 pa.array([payload], pa.binary())], names=["part", "before", "n_tokens", "n_documents", "payload"])

        for b in W.chunks(batches, "text"):
            off, values = enc.encode(*W.utf8(b.column("text")))
            if len(tail):
                values = np.insert(values, off[1:], tail[0])
                off = off + np.arange(len(off))
            size, own = np.diff(off), b.column("doc_id").to_pylist()
            at = 0
            while at < len(size):
                # as many documents as fit, one at least
                room = np.searchsorted(np.cumsum(size[at:]), shard_tokens - held, side="right")
                n = int(room) or (0 if doc_ids else 1)
                if n:
                    ids.append(values[off[at]:off[at + n]].astype(kind))
                    doc_ids += own[at:at + n]
                    sizes += size[at:at + n].tolist()
                    held, at = held + int(off[at + n] - off[at]), at + n
                if at < len(size):
                    yield shard()
                    before += held
                    ids, doc_ids, sizes, held = [], [], [], 0
        if doc_ids:
            yield shard()
    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID,
          id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs``, write them to files under ``path`` and return the files, as ``shards``.

    The ids of a text equal the library's for the whole text without special tokens
    added; then comes ``end_id`` (None: no end). ``tokenizer`` is a file that every
    executor can read, of the kind described above. The order is ascending doc_id, null
    first; rows of one id go by a hash of their text, and a hot id is still dealt over
    several tasks. Shards hold whole documents up to ``shard_tokens`` ids, a longer
    document alone. A null text counts as empty; repeated rows stay, each as a document
    of its own; other columns are ignored. An empty table leaves no shard."""
    require_columns(docs, [id_col, text_col], "write")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "h", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    pack = _pack(tokenizer or default_tokenizer(), end_id, shard_tokens, spark.sparkContext.broadcast({}))
    rows.mapInArrow(pack, SHARDS).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)
    return shards(spark, path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards under ``path``: part, before (ids before the shard in its part),
    n_tokens, n_documents, payload and start (ids before the shard in all). One row per
    part, of which there are as many as tasks wrote, goes through one window."""
    found = spark.read.schema(SHARDS).parquet(path)
    ends = found.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return (found.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before")).drop("base"))


def _each(files: DataFrame, ask, schema: str, names: list[str], extra: str = "") -> DataFrame:
    """Rows that ``ask(matrix, doc_ids, sizes, start)`` yields as columns for every shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start = b.column("start")[i].as_py()
                for columns in ask(*from_bytes(b.column("payload")[i].as_py()), start):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("start", "payload").mapInArrow(run, schema)


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read from the files: start is
    the number of ids of all documents before it."""
    def ask(matrix, doc_ids, sizes, start):
        ids, off = matrix.ids(), np.append(0, np.cumsum(sizes))
        step = 1024
        for a in range(0, len(sizes), step):
            at = off[a:a + step + 1]
            yield [pa.array(doc_ids[a:a + step], pa.int64()), pa.array(at[:-1] + start),
                   pa.array(sizes[a:a + step]), W.blobs(ids.astype("<u4"), at)]

    return _each(files, ask, "doc_id long, start long, n_tokens long, ids binary", ["doc_id", "start", "n_tokens", "ids"])


def counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each of ``tokens`` in all files, by rank alone."""
    tokens = sorted(set(tokens))

    def ask(matrix, doc_ids, sizes, start):
        yield [pa.array(tokens, pa.int64()), pa.array(matrix.count(tokens), pa.int64())]

    return (_each(files, ask, "token long, n long", ["token", "n"]).groupBy("token").agg(F.sum("n").alias("n")))


def occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, at, place): every occurrence of ``tokens``, by select alone; ``at``
    counts from the document's start, ``place`` from that of all files."""
    tokens = sorted(set(tokens))

    def ask(matrix, doc_ids, sizes, start):
        end, ids = np.cumsum(sizes), pa.array(doc_ids, pa.int64())
        for t in tokens:
            place = matrix.occurrences(t)
            doc = np.searchsorted(end, place, side="right")
            yield [pa.array(np.full(len(place), t, np.int64)), ids.take(pa.array(doc)),
                   pa.array(place - (end - sizes)[doc]), pa.array(place + start)]

    return _each(files, ask, "token long, doc_id long, at long, place long", ["token", "doc_id", "at", "place"])


def tokens_at(files: DataFrame, places: list[int]) -> DataFrame:
    """(place, token) for those of ``places`` that the files hold, by access alone."""
    want = np.array(sorted(set(places)), np.int64)

    def ask(matrix, doc_ids, sizes, start):
        at = want[(want >= start) & (want < start + matrix.n)]
        yield [pa.array(at), pa.array(matrix.access(at - start))]

    return _each(files, ask, "place long, token long", ["place", "token"])

