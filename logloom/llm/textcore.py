"""Word and byte views over Arrow text columns, in numpy. No Spark here.

Texts are handled in pieces of a few MB (a longer text is a piece of its own), so memory follows the piece,
not the batch. Word hashes are 64-bit polynomials over a word's bytes, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WBASE = 0xD6E8FEB86659FD93

_byte = np.arange(256)
#: Bytes that are part of a word `[^\x20\x09-\x0D]+`.
SPACE_WORD = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
#: Bytes that are part of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
#: A-Z to a-z, other bytes as they are.
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand; pickles empty."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def __reduce__(self):
        return Powers, (self.base,)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(n, b, _U)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=_U))
        return self.up, self.down


BYTE_POWERS, WORD_POWERS = Powers(_BASE), Powers(_WBASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def by_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ from text to text, too. Texts' numbers are moved far from what short words are hashed from."""
    return mix(h ^ mix(text.astype(_U) + _U(_BASE)))


def range_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of items lo..hi-1 for a prefix sum from prefix_sum()."""
    return (prefix[hi] - prefix[lo]) * powers.get(len(prefix))[1][lo]


def prefix_sum(items: np.ndarray, powers: Powers) -> np.ndarray:
    up = powers.get(len(items) + 1)[0][: len(items)]
    out = np.zeros(len(items) + 1, _U)
    np.cumsum((items.astype(_U) + _U(1)) * up, out=out[1:])
    return out


class Piece:
    """Consecutive texts of a column, joined by newlines: bytes, and where each text begins and ends."""

    def __init__(self, lo: int, col: pa.Array) -> None:
        self.lo, self.n = lo, len(col)
        offs = offsets(col)
        lens = np.diff(offs)
        self.begin = np.concatenate(([0], np.cumsum(lens + 1)))[:-1].astype(np.int64)
        self.end = self.begin + lens
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, self.n], pa.int32()), col), "\n")
        o = offsets(joined)
        self.buf = np.frombuffer(joined.buffers()[2], np.uint8)[o[0] : o[1]]

    def text(self, i: int) -> bytes:
        return self.buf[self.begin[i] : self.end[i]].tobytes()


class Words:
    """Words of a piece. start, end: bytes of each word; off: first word of each text, then the total."""

    def __init__(self, piece: Piece, word_bytes: np.ndarray, lower: bool = False) -> None:
        self.piece = piece
        self.buf = LOWER[piece.buf] if lower else piece.buf
        m = np.zeros(len(self.buf) + 2, np.int8)
        m[1:-1] = word_bytes[self.buf]
        edge = np.diff(m)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.off = np.append(np.searchsorted(self.start, piece.begin), len(self.start)).astype(np.int64)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.piece.n), self.count)

    def hashes(self) -> np.ndarray:
        p = prefix_sum(self.buf, BYTE_POWERS)
        return mix(range_hash(p, self.start, self.end, BYTE_POWERS) ^ (self.end - self.start).astype(_U))

    def windows(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of words i..i+k-1 for each i; only those with i + k <= the text's end mean anything."""
        if len(hashes) < k:
            return np.zeros(0, _U)
        p = prefix_sum(hashes, WORD_POWERS)
        i = np.arange(len(hashes) - k + 1)
        return mix(range_hash(p, i, i + k, WORD_POWERS) ^ _U(k))

    def fits(self, k: int) -> np.ndarray:
        """Whether words i..i+k-1 are of one text, for the i that windows() has."""
        n = max(0, len(self.start) - k + 1)
        last = np.repeat(self.off[1:], self.count)[:n]
        return np.arange(n) + k <= last


def offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def pieces(col: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a column in pieces of at most `most` bytes, or of one text. A null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    offs, lo = offsets(col), 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield Piece(lo, col.slice(lo, hi - lo))
        lo = hi


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last indices of the runs of true values."""
    e = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(e == 1), np.flatnonzero(e == -1)


def per_text(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[begin:end]."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return c[end] - c[begin]
