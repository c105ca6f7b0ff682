"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The vocabulary is a public byte-fallback BPE model, read from a path and never
trained. Texts become code points; a space is the mark U+2581 and one mark is put in
front, as the model's settings ask. No piece holds a mark behind another character,
so a text falls apart into units that are encoded alone, each distinct one once.

Units of equal length advance together through the lattice: at every end position the
substrings of up to the longest piece's length are hashed from prefix sums and
looked up among the sorted piece keys, and the maximum over them stores the
backpointer. In a merge model the best path is the one the merges give, not the one
of the largest score sum, so a piece may follow another only if merging the two
texts alone leaves exactly these two. By locality of merges that admits exactly one
path, which is the library's own output. Pair verdicts are merged in batches and kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..checks import require_columns
from . import words as W

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
KEPT_UNITS = 200_000   # encoded units kept by a task; beyond, it starts anew
PAIR_SLOTS = 1 << 19   # table of pair verdicts; emptied when half full
CHUNK_BYTES = 1 << 20
PAIR_BITS = 1 << 20    # table of neighbouring characters
LONG, SPAN, OVERLAP = 512, 256, 64   # units longer than LONG are encoded in overlapping spans
_BATCH = 1 << 18       # lattice cells at once

_P = np.uint64(0x9E3779B97F4A7C15)


def _value(cp: np.ndarray) -> np.ndarray:
    return W.mix(cp.astype(np.uint64) + np.uint64(0x51ED270B))


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * _P ^ y.astype(np.uint64)) * _P >> np.uint64(64 - PAIR_BITS.bit_length() + 1)).astype(np.int64)


def load_vocabulary(path: str = DEFAULT_MODEL) -> dict:
    """Plain arrays of a SentencePiece model; bounded by the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    raw, byte_id = [], np.full(256, sp.unk_id(), np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(texts[i][3:5], 16)] = i
            raw.append(bytes([int(texts[i][3:5], 16)]))
        else:
            raw.append(b"" if sp.is_control(i) else texts[i].replace(chr(MARK), " ").encode())
    order = np.argsort([-sp.get_score(i) for i in plain], kind="stable")
    rank = np.full(n, n, np.int64)
    score = np.array([sp.get_score(plain[i]) for i in order])
    rank[np.array(plain)[order]] = np.searchsorted(-score, -score)  # equal scores share a rank
    longest = max(len(texts[i]) for i in plain)
    cps = np.zeros((n, longest), np.uint32)
    size = np.zeros(n, np.int64)
    for i in plain:
        size[i] = len(texts[i])
        cps[i, :size[i]] = [ord(c) for c in texts[i]]
    v = _value(cps)
    inner = np.arange(longest - 1)[None, :] < (size - 1)[:, None]
    pairs = np.zeros(PAIR_BITS, bool)    # by a hash: two characters that stand together in some piece
    pairs[_pair(cps[:, :-1], cps[:, 1:])[inner]] = True
    pw = W.powers(_P, longest)
    h = np.zeros(n, np.uint64)
    for k in range(longest):  # the first character has the highest power
        h = np.where(size > k, h * _P + v[:, k], h)
    plain = np.array(plain)
    by = plain[np.argsort(h[plain], kind="stable")]
    lens = np.array([len(r) for r in raw], np.int64)
    return {"keys": h[by], "ids": by.astype(np.int64), "rank": rank, "size": size, "hash": h, "longest": longest,
            "singles": np.sort(cps[plain[size[plain] == 1], 0]), "used": np.unique(cps[plain])[1:],
            "pairs": pairs, "powers": pw, "byte_id": byte_id, "cps": cps, "raw": np.frombuffer(b"".join(raw), np.uint8),
            "raw_at": np.append(0, np.cumsum(lens)), "unknown": sp.unk_id()}


class Verdicts:
    """Open-addressing table from a pair's key to 0 or 1, for whole arrays of keys."""

    def __init__(self, slots: int = PAIR_SLOTS):
        self.slots = slots
        self.clear()

    def clear(self):
        self.key, self.value, self.used = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int8), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (W.mix(key) & np.uint64(self.slots - 1)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        out = np.full(len(key), -1, np.int8)
        rest, slot = np.arange(len(key)), self._slot(key)
        while len(rest):
            k = self.key[slot]
            hit = k == key[rest]
            out[rest[hit]] = self.value[slot[hit]]
            go = ~hit & (k >= 0)
            rest, slot = rest[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Add distinct new keys."""
        if len(key) > self.slots // 2:
            return
        if self.used + len(key) > self.slots // 2:
            self.clear()
        self.used += len(key)
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            self.key[slot[free]] = key[free]
            done = self.key[slot] == key
            self.value[slot[done]] = value[done]
            key, value, slot = key[~done], value[~done], (slot[~done] + 1) & (self.slots - 1)


class Encoder:
    """Encodes units; keeps verdicts on pairs and encoded units of one task."""

    def __init__(self, vocabulary: dict):
        self.__dict__.update(vocabulary)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.in_use = np.zeros(0x110000, bool)
        self.in_use[self.used] = True
        self.power = W.powers(_P, self.longest * 2 + 2)
        self.verdicts = Verdicts()
        self.reset()

    def reset(self):
        self.known = np.zeros(0, np.uint64)
        self.at, self.count, self.out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lookup(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Piece of a substring hash, -1 if there is none."""
        out = np.full(h.shape, -1, np.int64)
        may = np.nonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])  # most substrings are no piece
        some = h[may]
        i = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        p = self.ids[i]
        out[may] = np.where((self.keys[i] == some) & (self.size[p] == size[may]), p, -1)
        return out

    def merge(self, cps: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of symbols left, and the first one's length, after merging every row's
        characters alone: repeatedly the adjacent pair of the best rank, leftmost first."""
        n, width = cps.shape
        if not n:
            return np.zeros((0, 2), np.int64)
        far = np.iinfo(np.int64).max
        prefix = np.zeros((n, width + 1), np.uint64)
        v = _value(cps)
        for k in range(width):
            prefix[:, k + 1] = prefix[:, k] * _P + v[:, k]
        # symbols are described by their start positions, packed to the left
        start = np.tile(np.arange(width + 1), (n, 1))
        start = np.minimum(start, size[:, None])
        left = size.copy()
        rows = np.arange(n)
        while len(rows):
            s = start[rows]
            a, b = s[:, :-2], s[:, 2:]
            span = b - a
            two = np.arange(width - 1)[None, :] < (left[rows] - 1)[:, None]
            h = np.take_along_axis(prefix[rows], b, 1) - np.take_along_axis(prefix[rows], a, 1) * self.power[
                np.minimum(span, self.longest + 1)]
            p = np.where(two & (span <= self.longest), self.lookup(h, span), -1)
            r = np.where(p >= 0, self.rank[p], far)
            best = r.argmin(axis=1) if r.shape[1] else np.zeros(len(rows), np.int64)
            go = r[np.arange(len(rows)), best] < far if r.shape[1] else np.zeros(len(rows), bool)
            rows, best, s = rows[go], best[go], s[go]
            if not len(rows):
                break
            col = np.arange(width + 1)[None, :]
            nxt = np.concatenate([s[:, 1:], s[:, -1:]], axis=1)
            start[rows] = np.where(col > best[:, None], nxt, s)
            left[rows] -= 1
        return np.stack([left, start[:, 1]], axis=1)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece ``b`` follow piece ``a``? (a = -1: the unit's start)"""
        key = (a + 1) * len(self.size) + b
        got = self.verdicts.get(key)
        new = np.unique(key[got < 0])
        if len(new):
            x, y = new // len(self.size) - 1, new % len(self.size)
            sx = np.where(x >= 0, self.size[x], 0)
            col = np.arange(int((sx + self.size[y]).max()))[None, :]
            cps = np.where(col < sx[:, None], self.cps[x][:, np.minimum(col[0], self.longest - 1)], 0)
            at = col - sx[:, None]
            inside = (at >= 0) & (at < self.size[y][:, None])
            cps = np.where(inside, np.take_along_axis(self.cps[y], np.clip(at, 0, self.longest - 1), 1), cps)
            left = self.merge(cps.astype(np.uint32), sx + self.size[y])
            ok = np.where(x >= 0, (left[:, 0] == 2) & (left[:, 1] == sx), left[:, 0] == 1)
            self.verdicts.put(new, ok)
            got = np.where(got < 0, ok[np.minimum(np.searchsorted(new, key), len(new) - 1)], got)
        return got > 0

    def viterbi(self, cps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of the pieces of units given as rows with descending sizes. All
        rows advance together; those of equal length end together."""
        n, length = cps.shape
        prefix = np.zeros((n, length + 1), np.uint64)
        v = _value(cps)
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * _P + v[:, k]
        back = np.full((n, length + 1), -1, np.int64)
        reached = np.zeros((n, length + 1), bool)
        reached[:, 0] = True
        for end in range(1, length + 1):
            m = int(np.searchsorted(-size, -end, side="right"))  # rows of at least this size
            steps = np.arange(1, min(self.longest, end) + 1)
            h = prefix[:m, end][:, None] - prefix[:m, end - steps] * self.power[steps]
            p = np.where(reached[:m, end - steps], self.lookup(h, np.broadcast_to(steps, h.shape)), -1)
            r, c = np.nonzero(p >= 0)
            ok = self.follows(back[r, end - steps[c]], p[r, c])
            gain = np.zeros(p.shape, np.int64)   # the length of an admissible last piece
            gain[r[ok], c[ok]] = steps[c[ok]]
            best = gain.argmax(axis=1)
            hit = np.flatnonzero(gain[np.arange(m), best])
            reached[hit, end] = True
            back[hit, end] = p[hit, best[hit]]
        rows = np.arange(n)
        if not reached[rows, size].all():
            raise ValueError("a unit has no path: the vocabulary lacks one of its characters")
        ids = np.zeros((n, length), np.int64)
        count, at = np.zeros(n, np.int64), size.copy()
        while len(rows):
            p = back[rows, at[rows]]
            ids[rows, length - 1 - count[rows]] = p
            count[rows] += 1
            at[rows] -= self.size[p]
            rows = rows[at[rows] > 0]
        keep = np.arange(length)[None, :] >= (length - count)[:, None]
        return count, ids[keep].astype(np.int32)

    def encode_long(self, cp: np.ndarray, start: int, size: int, shift: int | None = None) -> np.ndarray | None:
        """Ids of one long unit from spans that overlap and advance together, None if they
        do not fit. Neighbouring spans are joined at a place where both have a border and
        the piece after it may follow the piece before it: then every neighbouring pair of
        the whole is admissible, and there is only one such path. Spans of a repeated
        pattern may never fit, as each begins it anew; they are tried again, begun ``shift``
        places later, where the first one has a border."""
        cut = np.arange(0, size, SPAN)
        low, high = np.maximum(cut - OVERLAP, 0), np.minimum(cut + SPAN + OVERLAP, size)
        low[1:] = np.minimum(low[1:] + (shift or 0), cut[1:])
        count, ids = self.encode_units(cp, start + low, high - low)
        span = np.repeat(np.arange(len(cut)), count)
        n = self.size[ids]
        end = np.cumsum(n)
        first = np.append(0, np.cumsum(count))[:-1]
        end = end - np.repeat(end[first] - n[first] - low, count)
        begin = end - n
        # borders of a span near its end, and of the next span near its start, by (join, place)
        left = np.flatnonzero((span < len(cut) - 1) & (end >= cut[np.minimum(span + 1, len(cut) - 1)] - OVERLAP))
        right = np.flatnonzero((span > 0) & (begin <= cut[span] + OVERLAP))
        key = lambda join, place: join * (size + 1) + place
        _, a, b = np.intersect1d(key(span[left] + 1, end[left]), key(span[right], begin[right]), return_indices=True)
        a, b = left[a], right[b]
        ok = self.follows(ids[a], ids[b])
        join, place = span[b][ok], begin[b][ok]
        order = np.lexsort((np.abs(place - cut[join]), join))
        join, place = join[order], place[order]
        near = np.append(True, join[1:] != join[:-1]) if len(join) else np.zeros(0, bool)
        if int(near.sum()) != len(cut) - 1:
            after = end[(span == 0) & (end >= low[1])] - low[1] if shift is None else end[:0]
            return self.encode_long(cp, start, size, int(after.min())) if len(after) else None
        border = np.concatenate([[0], place[near], [size]])
        return ids[(begin >= border[span]) & (end <= border[span + 1])]

    def encode_units(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray):
        """(counts, ids in order) of units given by their place in ``cp``; a unit of one
        character that the vocabulary lacks becomes its UTF-8 bytes."""
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        strange = (size == 1) & ~np.isin(cp[start], self.singles)
        for u in np.flatnonzero(strange).tolist():
            ids = self.byte_id[list(chr(int(cp[start[u]])).encode("utf-8"))]
            parts.append((np.array([u]), np.array([len(ids)]), ids))
        plain = np.flatnonzero(~strange)
        for u in plain[size[plain] > LONG].tolist():
            ids = self.encode_long(cp, int(start[u]), int(size[u]))
            if ids is not None:
                parts.append((np.array([u]), np.array([len(ids)]), ids))
                plain = plain[plain != u]
        plain = plain[np.argsort(-size[plain], kind="stable")]
        i = 0
        while i < len(plain):  # rows of a matrix have at least half the longest one's size
            length = int(size[plain[i]])
            j = int(np.searchsorted(-size[plain], -(length // 2), side="left"))
            j = max(i + 1, min(j, i + max(1, _BATCH // (4 * length))))
            w = plain[i:j]
            at = np.minimum(np.arange(length)[None, :], size[w][:, None] - 1)
            parts.append((w, *self.viterbi(cp[start[w][:, None] + at], size[w])))
            i = j
        for w, c, _ in parts:
            count[w] = c
        at = np.append(0, np.cumsum(count))
        out = np.zeros(at[-1], np.int32)
        for w, c, ids in parts:
            inner = np.arange(len(ids)) - np.repeat(np.cumsum(c) - c, c)
            out[np.repeat(at[w], c) + inner] = ids
        return count, out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a chunk of UTF-8 texts."""
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum((data & 0xC0) != 0x80))[off]
        some = at[:-1] < at[1:]
        cp = np.insert(np.where(cp == 0x20, MARK, cp).astype(np.uint32), at[:-1][some], MARK)
        at = at + np.append(0, np.cumsum(some))
        n = len(cp)
        if not n:
            return np.zeros(len(off), np.int64), np.zeros(0, np.int32)
        mark = cp == MARK
        alone = ~self.in_use[cp]
        head = mark.copy()
        head[1:] &= ~mark[:-1]
        head[1:] |= ~self.pairs[_pair(cp[:-1], cp[1:])]   # no piece holds both: no merge can join them
        head |= alone
        head[1:] |= alone[:-1]
        head[at[:-1][some]] = True
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, n))
        pos = np.arange(n) - np.repeat(start, size)
        h = W.mix(np.add.reduceat(_value(cp) * W.powers(_P, int(size.max()))[pos], start) + size.astype(np.uint64))
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_UNITS:
            self.reset()
        j = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[j] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            count, ids = self.encode_units(cp, start[first[new]], size[first[new]])
            where = len(self.out) + np.append(0, np.cumsum(count))[:-1]
            self.out = np.concatenate([self.out, ids])
            known = np.concatenate([self.known, uniq[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at = np.concatenate([self.at, where])[order]
            self.count = np.concatenate([self.count, count])[order]
        k = np.searchsorted(self.known, uniq)[inv]
        c = self.count[k]
        total = np.append(0, np.cumsum(c))
        ids = self.out[np.repeat(self.at[k], c) + np.arange(total[-1]) - np.repeat(total[:-1], c)]
        return total[np.searchsorted(start, at)], ids


def decode_ids(vocabulary: dict, at: np.ndarray, ids: np.ndarray) -> list[str]:
    """Texts of piece ids: joined piece texts without the first mark; bytes that are no
    UTF-8 become U+FFFD each; ids outside the vocabulary raise."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary["size"])):
        raise ValueError("piece id outside the vocabulary")
    raw_at, raw = vocabulary["raw_at"], vocabulary["raw"]
    n = np.diff(raw_at)[ids]
    total = np.append(0, np.cumsum(n))
    data = raw[np.repeat(raw_at[ids], n) + np.arange(total[-1]) - np.repeat(total[:-1], n)].tobytes()
    edge = total[at].tolist()
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        if a < b and data[a:a + 1] == b" ":
            a += 1
        out.append(data[a:b].decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL, keep=None) -> DataFrame:
    """``docs`` with piece_ids (array<int>) and n_pieces added; they replace columns of
    the same name, ``keep`` names the columns that go through (all by default).

    Null and empty texts have no pieces. Ids equal those of the SentencePiece library
    for the same model; a character without a piece becomes its UTF-8 bytes."""
    require_columns(docs, [text_col], "encode")
    names = [c for c in (keep or docs.columns) if c not in ("piece_ids", "n_pieces")]
    out = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))  # bounded by the vocabulary
    src, column = W.with_text(docs, names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(held.value)
        for b in W.chunks(batches, column, CHUNK_BYTES):
            at, ids = enc.encode(*W.utf8(b.column(column)))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists, pa.array(np.diff(at))],
                                             names=[*names, "piece_ids", "n_pieces"])

    return src.mapInArrow(run, out)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", model: str = DEFAULT_MODEL,
           text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col`` (replaced if there is one): the text of ``ids_col``.
    A null list has the empty text; null elements raise."""
    require_columns(encoded, [ids_col], "decode")
    names = [c for c in encoded.columns if c != text_col]
    out = T.StructType([encoded.schema[c] for c in names] + [T.StructField(text_col, T.StringType())])
    held = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                lists = b.column(ids_col)
                size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                ids = lists.flatten()
                if ids.null_count:
                    raise ValueError("null piece id")
                texts = decode_ids(v, np.append(0, np.cumsum(size)), ids.to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string())],
                                                 names=[*names, text_col])

    return encoded.mapInArrow(run, out)
