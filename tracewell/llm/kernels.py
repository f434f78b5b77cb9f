"""Vectorised byte and word kernels shared by the text operators.

Every kernel works on one *chunk*: the UTF-8 bytes of some texts laid end to
end plus the offsets of the texts.  Words and windows never cross a text.
Chunks hold about ``CHUNK_BYTES``; a text longer than that is a chunk alone.
Hashes select candidates, and callers confirm what must be exact on the bytes
themselves (`exact_ids`): a polynomial modulo 2^64 gives some pairs of long
strings the same hash whatever its base, and any 64-bit hash some pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table: True for bytes that belong to a word."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z became a-z: the table takes A-Z too
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n, kept and grown by doubling."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            out = np.empty(size, dtype=_U)
            out[0] = 1
            done = 1
            while done < size:
                step = _U(pow(base, done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * P^i, from 0; one longer than the input."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of [start, end) from prefix sums, independent of the position."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


_TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [_MASK], dtype=_U)
_LONG = 256  # bytes from which a word is hashed alone


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word: eight bytes at a time, each block mixed with what came before."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype=_U, buffer=padded.data, strides=(1,))
    length = ends - starts
    out = mix(length.astype(_U) * _U(_P))
    rows, at = np.flatnonzero(length <= _LONG), starts[length <= _LONG]
    while len(rows):
        left = ends[rows] - at
        out[rows] = mix(out[rows] * _U(_P) ^ (eight[at] & _TAIL[np.minimum(left, 8)]))
        more = left > 8
        rows, at = rows[more], at[more] + 8
    for i in np.flatnonzero(length > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the spans [a, a_end) and [b, b_end) hold the same bytes, for each pair."""
    same = (a_end - a) == (b_end - b)
    rows = np.flatnonzero(same & (a != b))
    long = a_end[rows] - a[rows] > _LONG
    for i in rows[long]:
        same[i] = np.array_equal(data[a[i] : a_end[i]], data[b[i] : b_end[i]])
    rows = rows[~long]
    for first in range(0, len(rows), 1 << 14):
        some = rows[first : first + (1 << 14)]
        n = (a_end - a)[some]
        differ = data[ragged(a[some], n)] != data[ragged(b[some], n)]
        same[some] = per_text(differ, np.concatenate([[0], np.cumsum(n)])) == 0
    return same


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number below len(starts) for each span, equal exactly where the bytes are: hashes only group the spans."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    lead = first[back]
    odd = np.flatnonzero(~same_bytes(data, starts, ends, starts[lead], ends[lead]))
    ids = lead.copy()
    known: dict[bytes, int] = {}
    for i in odd.tolist():  # other bytes than the first span of their hash
        ids[i] = known.setdefault(data[starts[i] : ends[i]].tobytes(), i)
    return ids


def exact_windows(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of `sizes` (up to k) ids from `first`, equal exactly where the runs are."""
    base = np.int64(ids.max(initial=0)) + 2
    code = ids[first] if len(first) else np.zeros(0, dtype=np.int64)
    for j in range(1, k):
        here = j < sizes
        step = np.where(here, ids[np.minimum(first + j, max(len(ids) - 1, 0))] + 1, 0) if len(first) else code
        # both factors are below the number of words of a text
        _, code = np.unique(code * base + step, return_inverse=True)
    return code


class Chunk:
    """Some whole texts as one byte buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and the number of words before
        each text (one longer than the number of texts)."""
        inside = table[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def bytes_prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        return prefix(_BYTE[self.data if data is None else data])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of about `limit` bytes."""
    if not len(column):
        return
    _, offsets = _buffers(column)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j - i
        i = j


def chunk(column: pa.Array) -> Chunk:
    """All texts of the column as one chunk."""
    data, offsets = _buffers(column)
    return Chunk(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def windows(word_hash: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at which a window of k words starts, and its hashes."""
    counts = np.maximum(np.diff(before) - k + 1, 0)
    starts = ragged(before[:-1], counts)
    return starts, spans_hash(prefix(word_hash), starts, starts + k)


def ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times, for each pair, laid end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = counts > 0
    firsts, counts = np.asarray(firsts)[keep], counts[keep]
    at = np.cumsum(counts) - counts
    out[at] = firsts
    out[at[1:]] -= firsts[:-1] + counts[:-1] - 1
    return np.cumsum(out)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions below n inside any [start, end)."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def runs(mask: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs, cut at the borders `before`."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[before] = True
    prev = np.zeros(len(mask), dtype=bool)
    prev[1:] = mask[:-1]
    nxt = np.zeros(len(mask), dtype=bool)
    nxt[:-1] = mask[1:]
    return np.flatnonzero(mask & (~prev | edge[:-1])), np.flatnonzero(mask & (~nxt | edge[1:])) + 1


def per_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of values per text, texts given by their borders."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[before])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
