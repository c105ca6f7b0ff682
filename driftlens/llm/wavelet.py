"""A sequence of token ids as a wavelet matrix: one succinct bit-plane per binary digit.

Plane by plane from the highest digit the sequence is split, zeros before ones, each in
order. A plane keeps its bits and, every 512 bits, the number of ones before; rank and
select read these, so that a token, the count of a token and its occurrences are found
without the sequence. The bytes of a shard are a header, the documents' ids and lengths,
and for each plane its number of zeros, directory and bits, all compressed."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"wvm1"
_HEAD = "<4sIQQ"   # magic, planes, ids, documents
_SPAN = 512                       # bits between two directory entries
_WORDS = _SPAN // 64


class Plane:
    """Bits with rank and select; ``n`` bits, of which ``zeros`` are 0."""

    def __init__(self, n: int, zeros: int, words: np.ndarray, before: np.ndarray):
        self.n, self.zeros, self.words, self.before = n, zeros, words, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        n = len(bits)
        spans = n // _SPAN + 1
        raw = np.zeros(spans * _SPAN // 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[:len(packed)] = packed
        words = raw.view("<u8")
        ones = np.bitwise_count(words).reshape(spans, _WORDS).sum(1, dtype=np.int64)
        return cls(n, n - int(ones.sum()), words, np.append(0, np.cumsum(ones))[:-1].astype("<u4"))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        span, word = at // _SPAN, at >> 6
        out = self.before[span].astype(np.int64)
        for j in range(_WORDS - 1):
            w = span * _WORDS + j
            out += np.where(w < word, np.bitwise_count(self.words[w]), 0)
        rest = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & rest)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero."""
        before = self.before.astype(np.int64)
        if not one:
            before = np.arange(len(before)) * _SPAN - before
        span = np.searchsorted(before, k, side="right") - 1
        left, word = k - before[span], span * _WORDS
        for _ in range(_WORDS - 1):
            c = self._count(word, one)
            go = left >= c
            left, word = np.where(go, left - c, left), word + go
            # a place is never beyond the last word of its span: its bit lies in the span
        w = self.words[word] if one else ~self.words[word]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = w & np.uint64((1 << half) - 1)
            c = np.bitwise_count(low).astype(np.int64)
            go = left >= c
            left, at = np.where(go, left - c, left), at + np.where(go, half, 0)
            w = np.where(go, w >> np.uint64(half), low)
        return word * 64 + at

    def _count(self, word: np.ndarray, one: bool) -> np.ndarray:
        w = self.words[word]
        return np.bitwise_count(w if one else ~w).astype(np.int64)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, ids: np.ndarray, digits: int) -> WaveletMatrix:
        planes, x = [], ids
        for d in range(digits - 1, -1, -1):
            b = (x & x.dtype.type(1 << d)) != 0
            planes.append(Plane.of(b))
            x = np.concatenate([x[np.flatnonzero(~b)], x[np.flatnonzero(b)]])  # places are faster than a mask
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """The whole sequence: from the lowest digit up, every split is undone."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for i, p in enumerate(reversed(self.planes)):
            b = p.bits()
            whole = np.empty_like(out)
            whole[np.flatnonzero(~b)] = out[:p.zeros]
            whole[np.flatnonzero(b)] = out[p.zeros:] | out.dtype.type(1 << i)
            out = whole
        return out

    def access(self, at) -> np.ndarray:
        """Ids at the places ``at``."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for p in self.planes:
            b, r = p.get(at), p.ones(at)
            out = out << 1 | b
            at = np.where(b, p.zeros + r, at - r)
        return out

    def _range(self, token: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        top = len(self.planes) - 1
        for i, p in enumerate(self.planes):
            b = token >> (top - i) & 1
            x, y = p.ones(lo), p.ones(hi)
            lo, hi = np.where(b, p.zeros + x, lo - x), np.where(b, p.zeros + y, hi - y)
        return lo, hi

    def count(self, token, lo=0, hi=None) -> np.ndarray:
        """Occurrences of each token among the places lo to hi (exclusive)."""
        token = np.asarray(token, np.int64)
        hi = self.n if hi is None else hi
        a, b = self._range(token, np.zeros_like(token) + lo, np.zeros_like(token) + hi)
        return np.where(token >> len(self.planes) > 0, 0, b - a)

    def occurrences(self, token: int) -> np.ndarray:
        """Ascending places of ``token``."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        lo, hi = self._range(np.array([token]), np.array([0]), np.array([self.n]))
        at = np.arange(int(lo[0]), int(hi[0]))
        for i, p in enumerate(reversed(self.planes)):
            one = bool(token >> i & 1)
            at = p.select(at - p.zeros if one else at, one)
        return at


def _packed(raw: bytes) -> bytes:
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return struct.pack("<QQ", len(raw), len(small)) + small


def to_bytes(matrix: WaveletMatrix, doc_ids: list, sizes: np.ndarray) -> bytes:
    """A shard: the matrix and its documents (id or None, number of ids), in order."""
    null = np.array([i is None for i in doc_ids], np.uint8)
    out = [struct.pack(_HEAD, MAGIC, len(matrix.planes), matrix.n, len(doc_ids)),
           _packed(np.array([i or 0 for i in doc_ids], "<i8").tobytes()), _packed(null.tobytes()),
           _packed(np.asarray(sizes, "<i8").tobytes())]
    for p in matrix.planes:
        out += [struct.pack("<Q", p.zeros), _packed(p.before.tobytes()), _packed(p.words.tobytes())]
    return b"".join(out)


def from_bytes(data: bytes):
    """(matrix, document ids, sizes) of a shard."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard of tokens")
    _, digits, n, docs = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)

    def take(kind):
        nonlocal at
        size, small = struct.unpack_from("<QQ", data, at)
        at += 16 + small
        return np.frombuffer(pa.decompress(data[at - small:at], size, codec="zstd", asbytes=True), kind)

    ids, null, sizes = take("<i8"), take(np.uint8), take("<i8")
    planes = []
    for _ in range(digits):
        zeros, = struct.unpack_from("<Q", data, at)
        at += 8
        before = take("<u4")
        planes.append(Plane(n, zeros, take("<u8"), before))
    if len(ids) != docs or sizes.sum() != n:
        raise ValueError("a shard's documents do not fit its ids")
    return WaveletMatrix(n, planes), [None if z else i for i, z in zip(ids.tolist(), null.tolist())], sizes.astype(np.int64)
