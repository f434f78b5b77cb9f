"""Windows of k units (words or bytes) that an earlier document holds too.

The common path of the two substring operators.  Documents are cut into runs
of consecutive windows with the same minimiser (the smallest hash of the
m-unit grams inside).  A window can only recur where its minimiser does, so

1. tasks send minimisers, packed, to hash ranges, where those of one document
   alone drop out (of a minimiser that many documents of a task hold, one entry
   stands for all);
2. runs with a shared minimiser are cut out of their texts and travel as one
   packed string each to the minimiser's bucket;
3. a bucket finds, exactly, the windows that also start in a document with a
   smaller key (by a caller's function: sorted windows, or a suffix array);
4. a bucket with very many strings is dealt out in parts; each part names its
   distinct windows by digest, and the parts' minima meet in a grouped minimum.

Documents with equal texts are one class; only its smallest key takes part.
Nothing is dropped, capped or sampled: limits only set how work is dealt.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm.frames import col, cut, drop_cut
from tracewell.sources.shared import SALTS

BLOCK_ENTRIES = 250_000  # minimisers, and documents, that a task packs at once
BLOCK_DOCS = 60_000
CHUNK_BYTES = 1 << 18
PART = 2_000  # strings of a minimiser per part of its bucket
SHARD_BYTES = 2 << 20  # strings, equal ones included, that a shard is made of
SEEN_BYTES = 12 << 20  # strings that a task remembers before it sends them
_LOW = (1 << 48) - 1


@dataclass(frozen=True)
class Units:
    """How a text is read: words (else bytes), window and gram lengths in units."""

    words: bool
    k: int = 50
    m: int = 12

    def values(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """A hash per unit, and the borders of the texts in units."""
        if not self.words:
            return K._BYTE[c.data], c.offsets
        starts, ends, before = c.words(K.SPACED)
        return K.spans_hash(c.bytes_prefix(), starts, ends), before

    def split(self, text: bytes) -> list[bytes] | bytes:
        # bytes.split() cuts at exactly \x20 and \x09-\x0D
        return text.split() if self.words else text

    def join(self, units) -> bytes:
        return b" ".join(units) if self.words else bytes(units)


def minimiser_runs(c: K.Chunk, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: hash, text, first window, number of windows."""
    values, before = units.values(c)
    n, w = len(values), units.k - units.m + 1
    counts = np.maximum(np.diff(before) - units.k + 1, 0)
    if not counts.any():
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    sums = K.prefix(values)
    grams = np.full(n + w, ~np.uint64(0))
    at = np.arange(n - units.m + 1)
    grams[: len(at)] = K.spans_hash(sums, at, at + units.m)
    low, reach = grams, 1
    while 2 * reach <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: len(low) - (w - reach)], low[w - reach :])
    starts = K.ragged(before[:-1], counts)
    of = np.repeat(np.arange(len(counts)), counts)
    h = low[starts]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(h)))
    return h[first], of[first], starts[first] - before[of[first]], length


def _pack(h: np.ndarray, idx: np.ndarray, start: np.ndarray, n: np.ndarray, count: np.ndarray) -> bytes:
    """Columns of entries (ordered by idx, start) as one small string."""
    planes = [np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()]
    for x in (np.diff(idx, prepend=0), np.diff(start, prepend=0), n, count):
        planes.append(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(z: bytes) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), dtype=np.uint8)
    size = len(data) // 22
    h = np.zeros((size, 8), dtype=np.uint8)
    h[:, :6] = data[: 6 * size].reshape(6, size).T
    cols = [np.ascontiguousarray(data[(6 + 4 * i) * size : (10 + 4 * i) * size].reshape(4, size).T).view("<i4").ravel().astype(np.int64) for i in range(4)]
    return h.view("<u8").ravel().astype(np.int64), np.cumsum(cols[0]), np.cumsum(cols[1]), cols[2], cols[3]


def text_id(text: bytes) -> int:
    """What tells apart rows that repeat a key."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


_BLOBS = T.StructType(
    [T.StructField("r", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("z", T.BinaryType())]
)
_ENTRY, _ITEM, _HOT, _DOC = 0, 1, 2, 3


def _blobs(docs: DataFrame, units: Units, ranges: int) -> DataFrame:
    """Packed minimiser entries by hash range, locally shared ones apart, and the block's documents."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        state: dict = {}

        def fresh():
            state.update(h=[], idx=[], start=[], n=[], doc=[], did=[], size=0, first={})

        def flush():
            nonlocal seq
            if not state["doc"]:
                return
            block = (task << 24) | seq
            seq += 1
            doc = np.array(state["doc"], dtype=np.int64)
            did = np.array(state["did"], dtype=np.int64)
            h, idx, start, n = (np.concatenate(state[x]) for x in ("h", "idx", "start", "n"))
            # of equal texts in this block only the smallest key goes on
            best: dict[bytes, int] = state["first"]
            kept = np.zeros(len(doc), dtype=bool)
            kept[list(best.values())] = True
            keep = kept[idx]
            # minimisers are small hashes: mixed again, they fill all ranges alike
            h, idx, start, n = K.mix(h[keep]), idx[keep], start[keep], n[keep]
            key = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            low = h & np.uint64(_LOW)
            order = np.lexsort((low, key))
            key, low, idx, start, n = key[order], low[order], idx[order], start[order], n[order]
            new = np.ones(len(low), dtype=bool)
            new[1:] = (low[1:] != low[:-1]) | (key[1:] != key[:-1])
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(low)))
            if len(at):
                shared = np.maximum.reduceat(doc[idx], at) != np.minimum.reduceat(doc[idx], at)
            else:
                shared = np.zeros(0, dtype=bool)
            mine = shared[group] if len(at) else np.zeros(0, dtype=bool)
            count = np.where(mine, size[group] if len(at) else 0, 0)
            entry = ~mine | new
            rows = []
            for kind, part in ((_ENTRY, entry), (_ITEM, mine)):
                e = np.flatnonzero(part)
                if not len(e):
                    continue
                e = e[np.lexsort((start[e], idx[e], key[e]))]
                edge = np.flatnonzero(np.diff(key[e], prepend=-1))
                for a, b in zip(edge, np.append(edge[1:], len(e)), strict=True):
                    s = e[a:b]
                    rows.append((int(key[s[0]]), kind, _pack(low[s], idx[s], start[s], n[s], count[s])))
            used = np.unique(idx)
            spread = block * 7919
            yield pa.RecordBatch.from_arrays(
                [
                    # items need no meeting: they spread over all ranges by block
                    pa.array([r if kind == _ENTRY else (r * 31 + spread) % ranges for r, kind, _ in rows] + [spread % ranges], pa.int64()),
                    pa.array([kind | (r << 2 if kind == _ITEM else 0) for r, kind, _ in rows] + [_DOC], pa.int32()),
                    pa.array([block] * (len(rows) + 1), pa.int64()),
                    pa.array([z for *_, z in rows] + [b"".join(np.ascontiguousarray(x).astype("<i8").tobytes() for x in (used, doc[used], did[used]))], pa.binary()),
                ],
                _BLOBS.names,
            )

        fresh()
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, size in K.slices(b.column(1), CHUNK_BYTES):
                c = K.chunk(b.column(1).slice(i, size))
                h, of, start, n = minimiser_runs(c, units)
                base = len(state["doc"])
                state["h"].append(h)
                state["idx"].append(of + base)
                state["start"].append(start)
                state["n"].append(n)
                for j in range(size):
                    text = c.text(j)
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    key = int(keys[i + j])
                    at = state["first"].get(digest)
                    if at is None or key < state["doc"][at]:
                        state["first"][digest] = base + j
                    state["doc"].append(key)
                    state["did"].append(text_id(text))
                state["size"] += len(h)
                if state["size"] >= BLOCK_ENTRIES or len(state["doc"]) >= BLOCK_DOCS:
                    yield from flush()
                    fresh()
        yield from flush()

    return docs.mapInArrow(run, _BLOBS)


_FOUND = "kind int, block long, r long, z binary"


def _found(kind: int, block: int, r: int, z: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([r], pa.int64()), pa.array([z], pa.binary())], [x.split()[0] for x in _FOUND.split(", ")])


def _meet(blobs: DataFrame, partitions: int) -> DataFrame:
    """By block: packed entries whose minimiser lies in several documents (those shared in the block are
    passed on), its minimisers with over PART entries anywhere and the number of their parts, its documents."""

    def shared(r: int, parts: list[tuple[int, bytes]]):
        cols = [_unpack(z) for _, z in parts]
        at_block = np.repeat(np.arange(len(cols)), [len(x[0]) for x in cols])
        h, count = (np.concatenate([x[i] for x in cols]) for i in (0, 4))
        order = np.argsort(h, kind="stable")
        sorted_h, of = h[order], at_block[order]
        at = np.flatnonzero(np.diff(sorted_h, prepend=-1))
        size = np.diff(np.append(at, len(h)))
        several = np.empty(len(h), dtype=bool)
        several[order] = np.repeat(of[at] != of[np.append(at[1:], len(h)) - 1], size)
        total = np.add.reduceat(np.maximum(count[order], 1), at)
        split = np.empty(len(h), dtype=np.int64)
        split[order] = np.repeat(np.where(total > PART, np.minimum(total // PART + 1, 1 << 30), 1), size)
        # entries that stand for some of their block are passed on by it
        out = several & (count == 0)
        first = 0
        for (block, _), (own, idx, start, n, _) in zip(parts, cols, strict=True):
            mine, hot = out[first : first + len(own)], split[first : first + len(own)]
            first += len(own)
            if mine.any():
                z = _pack(own[mine].view(np.uint64), idx[mine], start[mine], n[mine], np.zeros(int(mine.sum()), dtype=np.int64))
                yield _found(_ITEM, block, r, z)
            if (hot > 1).any():
                yield _found(_HOT, block, r, np.concatenate([own[hot > 1], hot[hot > 1]]).tobytes())

    def run(batches):
        r, parts = None, []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for now, kind, block, z in zip(*(x.to_pylist() for x in b.slice(i, 256).columns), strict=True):
                    if kind & 3 == _ITEM:
                        yield _found(_ITEM, block, kind >> 2, z)
                    elif kind == _DOC:
                        yield _found(_DOC, block, 0, z)
                    else:
                        if now != r and parts:
                            yield from shared(r, parts)
                            parts = []
                        r = now
                        parts.append((block, z))
        if parts:
            yield from shared(r, parts)

    return blobs.repartition(partitions, "r").sortWithinPartitions("r").mapInArrow(run, _FOUND)


_OWNED = "doc long, did long, items binary"


def _items(h: np.ndarray, start: np.ndarray, n: np.ndarray, parts: np.ndarray) -> bytes:
    small = np.concatenate([np.diff(start, prepend=0), n, parts]).astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(h.astype("<i8").tobytes() + np.ascontiguousarray(small).tobytes())


def _entries(items: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(items), dtype=np.uint8)
    size = len(data) // 20
    start, n, parts = np.ascontiguousarray(data[8 * size :].reshape(4, -1).T).view("<i4").reshape(3, -1)
    return data[: 8 * size].view("<i8").tolist(), np.cumsum(start).tolist(), n.tolist(), parts.tolist()


def _by_document(found: DataFrame) -> DataFrame:
    """(doc, did, items): each document's entries (hash, first window, number of windows, parts), met by block."""
    rows = found.select("block", "kind", "r", "z").repartition("block").sortWithinPartitions("block", "kind")

    def owned(parts: list[tuple[int, bytes]], hot: list[tuple[int, bytes]], doc: bytes):
        if not parts:
            return
        cols = [_unpack(z)[:4] for _, z in parts]
        h = np.concatenate([x[0] | (np.int64(r) << 48) for (r, _), x in zip(parts, cols, strict=True)])
        idx, start, n = (np.concatenate([x[i] for x in cols]) for i in (1, 2, 3))
        split = np.ones(len(h), dtype=np.int64)
        if hot:
            both = [np.frombuffer(z, dtype="<i8").reshape(2, -1) for _, z in hot]
            many = np.concatenate([x[0] | (np.int64(r) << 48) for (r, _), x in zip(hot, both, strict=True)])
            many, at = np.unique(many, return_index=True)
            at = np.concatenate([x[1] for x in both])[at]
            k = np.minimum(np.searchsorted(many, h), len(many) - 1)
            split = np.where(many[k] == h, at[k], 1)
        order = np.lexsort((start, idx))
        columns = [x[order] for x in (h, start, n, split)]
        idx = idx[order]
        at = np.flatnonzero(np.diff(idx, prepend=-1))
        items = [_items(*(x[a:z] for x in columns)) for a, z in zip(at, np.append(at[1:], len(idx)), strict=True)]
        used, docs, dids = np.frombuffer(doc, dtype="<i8").reshape(3, -1)
        k = np.searchsorted(used, idx[at])
        yield pa.RecordBatch.from_arrays([pa.array(docs[k]), pa.array(dids[k]), pa.array(items, pa.binary())], ["doc", "did", "items"])

    def run(batches):
        block, parts, hot = None, [], []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for now, kind, r, z in zip(*(x.to_pylist() for x in b.slice(i, 256).columns), strict=True):
                    if now != block:
                        block, parts, hot = now, [], []
                    if kind == _DOC:  # comes once, after the others
                        yield from owned(parts, hot, z)
                    else:
                        (parts if kind == _ITEM else hot).append((r, z))

    return rows.mapInArrow(run, _OWNED)


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text): rows with a key; null texts are empty."""
    return docs.where(col(key).isNotNull()).select(col(key).cast("long").alias("doc"), F.coalesce(col(text), F.lit("")).alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for i, n in K.slices(b.column(1)):
                texts = b.column(1).slice(i, n).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array([text_id(t) for t in texts], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary())], ["doc", "did", "z"]
                )

    return rows.mapInArrow(run, "doc long, did long, z binary")


_STRINGS = "kind int, h long, part int, hot boolean, doc long, did long, start int, n int, s binary"


def _strings(candidates: DataFrame, units: Units) -> DataFrame:
    """Packed strings of runs; one that the task has sent for a smaller key is a hit at once (kind 1)."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _STRINGS.split(", ")]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        least: dict[tuple[int, bytes], int] = {}
        held = 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                runs = []
                if held > SEEN_BYTES:
                    least.clear()
                    held = 0
                for doc, did, z, items in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    text = units.split(unpack.decompress(z))
                    for h, a, n, parts in zip(*_entries(items), strict=True):
                        s = units.join(text[a : a + n + units.k - 1])
                        runs.append((h, s, doc, did, a, n, parts))
                        known = least.get((h, s))
                        if known is None:
                            held += len(s) + 200
                        if known is None or known > doc:
                            least[h, s] = doc
                rows = []
                for h, s, doc, did, a, n, parts in runs:
                    if doc > least[h, s]:
                        # neighbouring runs of a document are one
                        if rows and rows[-1][0] == 1 and rows[-1][4:6] == (doc, did) and rows[-1][6] + rows[-1][7] == a:
                            rows[-1] = (*rows[-1][:7], rows[-1][7] + n, None)
                        else:
                            rows.append((1, doc * 31 + a, 0, False, doc, did, a, n, None))
                    else:
                        rows.append((0, h, hash((doc, did)) % parts, parts > 1, doc, did, a, n, s))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return candidates.select("doc", "did", "z", "items").mapInArrow(run, _STRINGS)


#: From strings and their keys, in one shard: (row, first window, number of windows) that start in a
#: string of a smaller key too; and for rows in `hot`: (row, window) of the smallest key of each distinct window.
Finder = Callable[[list[bytes], list[int], list[bool]], tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]

_HITS = "kind int, doc long, did long, start int, n int, digest binary"


def _buckets(strings: DataFrame, units: Units, finder: Finder) -> DataFrame:
    """Hits (kind 1), and distinct windows of buckets dealt out in parts (kind 2)."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _HITS.split(", ")]

    def solve(groups: list[list[tuple]]) -> list[tuple]:
        """Hits and distinct windows of buckets' parts, rows (hot, doc, did, start, n, string) by doc."""
        out, left = [], []
        for rows in groups:
            least: dict[bytes, int] = {}
            for r in rows:
                least.setdefault(r[5], r[1])
            if len(least) == len(rows):  # no string repeats
                if len(rows) > 1 or rows[0][0]:
                    left += rows
                continue
            several = len(least) > 1
            for r in rows:
                if r[1] > least[r[5]]:
                    out.append((1, r[1], r[2], r[3], r[4], None))
                elif several or r[0]:
                    left.append(r)
        same: dict[bytes, list[tuple]] = defaultdict(list)
        for r in left:
            same[r[5]].append(r)
        for s, owners in same.items():  # parts of one bucket can hold a string under different keys
            if len(owners) == 1:
                continue
            low = min(r[1] for r in owners)
            out += [(1, r[1], r[2], r[3], r[4], None) for r in owners if r[1] > low]
            same[s] = [r for r in owners if r[1] == low]
        texts, owners = list(same), list(same.values())
        hits, firsts = finder(texts, [o[0][1] for o in owners], [o[0][0] for o in owners]) if texts else ([], [])
        for i, a, n in hits:
            out += [(1, r[1], r[2], r[3] + a, n, None) for r in owners[i]]
        for i, a in firsts:
            digest = hashlib.blake2b(units.join(units.split(texts[i])[a : a + units.k]), digest_size=16).digest()
            out += [(2, r[1], r[2], r[3] + a, 1, digest) for r in owners[i]]
        return out

    def run(batches):
        held, size, last = [], 0, None

        def batch(out: list[tuple]):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            kind = b.column(0).to_numpy()
            if (kind == 1).any():  # known hits pass through
                told = b.filter(pa.array(kind == 1))
                yield pa.RecordBatch.from_arrays([*(told.column(i) for i in (0, 4, 5, 6, 7)), pa.nulls(told.num_rows, pa.binary())], names)
                b = b.filter(pa.array(kind == 0))
            for i in range(0, b.num_rows, 2048):
                some = b.slice(i, 2048)
                h, part = some.column(1).to_numpy(), some.column(2).to_numpy()
                new = np.append((h[0], part[0]) != last, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))
                last = h[-1], part[-1]
                out = []
                whole = [some.column(c).to_numpy(zero_copy_only=False).tolist() for c in range(3, 8)]
                for first, *r in zip(new.tolist(), *whole, some.column(8).to_pylist(), strict=True):
                    if first:
                        if size >= SHARD_BYTES:
                            out += solve(held)
                            held, size = [], 0
                        held.append([])
                    held[-1].append(r)
                    size += len(r[5])
                yield from batch(out)
        yield from batch(solve(held))

    return strings.repartition("h", "part").sortWithinPartitions("h", "part", "doc").mapInArrow(run, _HITS)


def runs_of(hits: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, number) from (row, window) pairs sorted by both."""
    if not len(hits):
        return []
    new = np.ones(len(hits), dtype=bool)
    new[1:] = (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1)
    at = np.flatnonzero(new)
    return [(int(r), int(a), int(n)) for (r, a), n in zip(hits[at], np.diff(np.append(at, len(hits))), strict=True)]


_META = "doc long, did long, digest string, n_units long, sha256 string"


def described(docs: DataFrame, units: Units, key: str, text: str) -> DataFrame:
    """A _META row per row: its ids, the digest of its text, and number and digest of its units."""

    def run(batches):
        for b in batches:
            for i, n in K.slices(b.column(1)):
                out = []
                for doc, t in zip(b.column(0).slice(i, n).to_pylist(), b.column(1).slice(i, n).cast(pa.binary()).to_pylist(), strict=True):
                    digest = K.sha256_hex(t)
                    body = units.split(t)
                    out.append((doc, text_id(t), digest, len(body), K.sha256_hex(b" ".join(body)) if units.words else digest))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _META.split(", ")])

    return docs.select(col(key).cast("long").alias("doc"), F.coalesce(col(text), F.lit("")).alias("text")).mapInArrow(run, _META)


def repeats(docs: DataFrame, meta: DataFrame, units: Units, finder: Finder, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(texts, cuts): packed texts (doc, did, z), and the unit ranges of each that are
    covered by windows that also start in a document of a smaller key (doc, did, cuts: start * 2^32 + length).

    meta: (doc, did, rep), rep the smallest key with an equal text; only
    representatives are looked into.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = identified(docs, key, text)
    found = cut(_meet(_blobs(rows, units, 4 * parts), parts), "minimisers")
    owned = _by_document(found).join(meta.where("doc = rep").select("doc", "did").distinct(), ["doc", "did"])
    # rows may repeat key and text: their entries are the same
    owned = owned.groupBy("doc", "did").agg(F.first("items").alias("items"))
    texts = cut(_packed(rows).join(owned, ["doc", "did"]).dropDuplicates(["doc", "did"]), "texts")
    drop_cut(found)
    hits = cut(_buckets(_strings(texts, units), units, finder), "hits")
    parted = hits.where("kind = 2")
    least = parted.groupBy("digest").agg(F.min("doc").alias("least")).withColumnRenamed("digest", "_digest")
    across = parted.join(least, F.col("digest") == F.col("_digest")).where("doc > least").select("doc", "did", "start", "n")
    every = hits.where("kind = 1").select("doc", "did", "start", "n").union(across)
    # first unit and number of units as one number: start < 2^31
    span = F.shiftleft(F.col("start").cast("long"), 32) + F.col("n") + (units.k - 1)
    cuts = every.groupBy("doc", "did").agg(F.collect_list(span).alias("cuts"))
    return texts.select("doc", "did", "z"), cuts


def deduplicate(docs: DataFrame, units: Units, finder: Finder, key: str, text: str) -> DataFrame:
    """One row per row: (key, n_units, n_removed, n_spans, kept_sha256, kept).

    kept (binary) is what is left, null where nothing was removed.  A row whose
    text equals that of a smaller key loses all of it, if it holds a window.
    Keys are whole numbers.  Null texts are empty.  Rows with a null key, and rows
    of the same key, never count as smaller: nothing is removed on their account.
    """
    told = cut(described(docs, units, key, text), "told")
    # only texts that repeat have a class to look up; its row goes to every salt, over which the equal texts are spread
    classes = told.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1")
    classes = classes.select(F.col("digest").alias("_digest"), "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("doc", "did"), F.lit(SALTS)).cast("int")
    both = told.withColumn("salt", salt).join(classes, (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")), "left")
    meta = cut(both.select("doc", "did", "n_units", "sha256", F.coalesce("rep", "doc").alias("rep")), "meta")
    drop_cut(told)
    left = cut_texts(*repeats(docs, meta, units, finder, key, text), units)
    left = left.select(F.col("doc").alias("_doc"), F.col("did").alias("_did"), "n_removed", "n_spans", F.col("sha256").alias("_sha256"), "kept")
    out = meta.join(left, (F.col("doc") == F.col("_doc")) & (F.col("did") == F.col("_did")), "left")
    gone = F.coalesce(F.col("doc") > F.col("rep"), F.lit(False)) & (F.col("n_units") >= units.k)
    kept = F.when(gone, F.lit(b"")).otherwise(F.col("kept"))
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("doc").alias(key),
        "n_units",
        F.when(gone, F.col("n_units")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("_sha256", "sha256")).alias("kept_sha256"),
        kept.alias("kept"),
    )


_CUT = "doc long, did long, n_removed long, n_spans long, sha256 string, kept binary"


def cut_texts(texts: DataFrame, cuts: DataFrame, units: Units) -> DataFrame:
    """What is left of each text with cuts."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out = []
                part = b.slice(i, 64)
                for r, (doc, did, z) in enumerate(zip(*(x.to_pylist() for x in part.columns[:3]), strict=True)):
                    body = units.split(unpack.decompress(z))
                    spans = part.column(3)[r].values.to_numpy()
                    mask = K.cover(len(body), spans >> 32, (spans >> 32) + (spans & 0xFFFFFFFF))
                    first, last = K.runs(mask, np.array([0, len(mask)]))
                    kept, at = [], 0
                    for x, y in zip(first.tolist(), last.tolist(), strict=True):
                        kept.append(body[at:x])
                        at = y
                    kept.append(body[at:])
                    left = b" ".join(w for part in kept for w in part) if units.words else b"".join(kept)
                    out.append((doc, did, int(mask.sum()), len(first), K.sha256_hex(left), left))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _CUT.split(", ")])

    return texts.join(cuts, ["doc", "did"]).mapInArrow(run, _CUT)
