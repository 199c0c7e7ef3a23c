"""Arrow and numpy helpers that the Python-side operators share.

Texts of a batch are laid end to end in one byte buffer, and words, word hashes
and shingle hashes are computed for the whole buffer by array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is taken whole.
SLICE_BYTES = 1 << 20

_U = np.uint64


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=_U)


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Whitespace of the word rule [^\x20\x09-\x0D]+.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
#: A-Z to a-z, for bytes.translate.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(lengths, limit: int = SLICE_BYTES):
    """Ranges (a, b) of consecutive texts with at most ``limit`` bytes, one text at least."""
    a, total = 0, 0
    for i, n in enumerate(lengths):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A random number for each byte at each of so many places of a word; places beyond mix in how often these were passed.
_PLACES = 32
_BYTES = mix(np.arange(_PLACES * 256, dtype=_U) * _U(_BASE) + _U(0x5851F42D4C957F2D))


class Words:
    """The whitespace-separated words of several texts.

    start, end: byte ranges in ``buf``; first: index of each text's first word,
    with the total at the end.
    """

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.buf = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.buf, dtype=np.uint8)
        gap = space[a]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: random numbers of its bytes by their places, summed, and mixed with its length."""
        a = np.frombuffer(self.buf, dtype=np.uint8)
        out = np.empty(len(self), dtype=_U)
        lo = 0
        while lo < len(self):  # in pieces that end with a word, so that tables stay small
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + SLICE_BYTES, side="right")))
            s0, e0 = int(self.start[lo]), int(self.end[hi - 1])
            s, e = self.start[lo:hi] - s0, self.end[lo:hi] - s0
            place = np.arange(e0 - s0) - np.repeat(s, np.diff(np.append(s, e0 - s0)))
            term = _BYTES[((place & (_PLACES - 1)) << 8) | a[s0:e0]]
            if len(far := np.flatnonzero(place >= _PLACES)):
                term[far] = mix(term[far] + (place[far] // _PLACES).astype(_U) * _U(_BASE))
            sums = np.zeros(e0 - s0 + 1, dtype=_U)
            np.cumsum(term, out=sums[1:])
            out[lo:hi] = mix(sums[e] - sums[s] + (e - s).astype(_U))
            lo = hi
        return out


def powers(n: int) -> np.ndarray:
    return _odd_powers(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _odd_powers(_BASE_INV, n)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (one array; runs over text ends are the caller's to skip)."""
    if len(words) < n:
        return np.empty(0, dtype=_U)
    sums = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse_powers(len(words) + 1 - n))


def shingle_index(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text) of every n-word shingle that stays within its text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(int(counts.sum())) - begin[text] + first[:-1][text], text


def list_array(values: np.ndarray, counts, kind: pa.DataType) -> pa.ListArray:
    """A list column from the concatenated values and each list's length."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def bit_sums(bits: np.ndarray) -> np.ndarray:
    """Column sums of rows of 0 and 1 (uint8); 255 rows at a time fit a byte, which adds far faster."""
    full = len(bits) // 255
    out = bits[full * 255 :].sum(0, dtype=np.uint8).astype(np.int64)
    if full:
        out += bits[: full * 255].reshape(full, 255, -1).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out
