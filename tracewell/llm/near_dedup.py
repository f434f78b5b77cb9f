"""Near-duplicate detection with HyperMinHash registers.

A document's set of word shingles is hashed into registers: the hash's first
bits name a bucket, and of the bucket's smallest remainder the number of
leading zeros and a few mantissa bits are kept.  Bands of registers propose
buckets of documents; the Jaccard similarity estimated from two documents'
registers, corrected for chance collisions, drops hopeless pairs; the rest are
verified on the full sets: of 64-bit shingle hashes first, which can only make
sets look more alike, and every pair that passes on the words themselves.

Equal word sequences are one class from the start, and everything below works on
classes:

1. stars: a bucket's hub is the member whose buckets are largest (of a group of
   edited copies the least edited one).  Each class is verified against the best
   hub of its buckets, and classes that hang together are contracted;
2. the rest: in a bucket that still holds several components, the members outside
   its largest one meet all members, in cells of bounded size that each lie in
   one task.  A first pass over registers finds who has a plausible partner, a
   second one verifies the pairs on these members' sets.  Pairs never leave a
   task; links do.

So every pair that shares a bucket is verified, found hopeless by its registers,
or of one component already: no cap, no sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm.components import components, roots
from tracewell.llm.frames import col, cut, drop_cut, map_text, read

P_BITS, MANTISSA = 7, 10
REGISTERS = 1 << P_BITS
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
CELL, CELL_SHINGLES = 2048, 1 << 19  # members of a bucket, and shingles in them, on a side of a cell
SET_BYTES = 1 << 20  # text bytes whose sets are made at once
TESTS = 1 << 14  # register rows compared at once
_EMPTY = np.uint16(0xFFFF)


class _Shingles:
    """The shingles of some texts: words, and for each shingle its first word, number of words and text.

    Words are runs of non-space characters after A-Z became a-z; a text of
    fewer than n words is one shingle, one without words has none.
    """

    def __init__(self, texts: pa.Array, n: int):
        c = K.chunk(texts)
        self.n, self.data, self.n_texts = n, K.LOWER[c.data], len(texts)
        self.starts, self.ends, self.before = c.words(K.SPACED)
        counts = np.diff(self.before)
        held = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
        self.first, self.of = K.ragged(self.before[:-1], held), np.repeat(np.arange(len(texts)), held)
        self.size = np.where(counts >= n, n, counts)[self.of]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether shingles a and b of one text have the same words, for each pair."""
        out = np.ones(len(a), dtype=bool)
        for j in range(self.n):
            rows = np.flatnonzero(out & (j < self.size[a]))
            x, y = self.first[a[rows]] + j, self.first[b[rows]] + j
            out[rows] = K.same_bytes(self.data, self.starts[x], self.ends[x], self.starts[y], self.ends[y])
        return out

    def _sets(self, h: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, self.of))
        h, of = h[order], self.of[order]
        again = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1])) + 1
        if not exact and len(again):
            again = again[self.same(order[again], order[again - 1])]
        new = np.ones(len(h), dtype=bool)
        new[again] = False
        h, of = h[new], of[new]
        return h, np.searchsorted(of, np.arange(self.n_texts + 1))

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingle hashes of each text laid end to end, and their borders; a hash stands as often as it has different shingles."""
        word = K.word_hash(self.data, self.starts, self.ends)
        return self._sets(K.spans_hash(K.prefix(word), self.first, self.first + self.size), False)

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """The same with numbers that are equal exactly where the words are, among these texts."""
        ids = K.exact_ids(self.data, self.starts, self.ends, K.word_hash(self.data, self.starts, self.ends))
        return self._sets(K.exact_windows(ids, self.first, self.size, self.n), True)

    def sequence(self, i: int) -> bytes:
        """The words of a text, joined by one space."""
        a, z = self.before[i], self.before[i + 1]
        return b" ".join(self.data[self.starts[a] : self.ends[z - 1]].tobytes().split()) if z > a else b""


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _Shingles(texts, n).hashed()


def registers(h: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x REGISTERS, uint16): leading zeros, then mantissa bits."""
    rest_bits = 64 - P_BITS
    least = np.full((len(borders) - 1) * REGISTERS, np.uint64(1 << rest_bits), dtype=np.uint64)
    of = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    # within a text hashes are sorted, so a bucket's first hash is its smallest
    slot = of * REGISTERS + (h >> np.uint64(rest_bits)).astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    least[slot[first]] = h[first] & np.uint64((1 << rest_bits) - 1)
    filled = least < np.uint64(1 << rest_bits)
    value = np.maximum(least, np.uint64(1))
    # exact bit length of values below 2^57, in two halves that doubles hold exactly
    high = (value >> np.uint64(32)).astype(np.float64)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp((value & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
    zeros = np.minimum(rest_bits - length, 62).astype(np.uint64)
    shift = length - 1 - MANTISSA
    up = np.where(shift < 0, value << np.maximum(-shift, 0).astype(np.uint64), value >> np.maximum(shift, 0).astype(np.uint64))
    out = ((zeros << np.uint64(MANTISSA)) | (up & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    return np.where(filled, out, _EMPTY).reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (texts x BANDS).

    Empty registers borrow from others in an order that is the same for all
    texts, so that a borrowed register agrees as often as the sets do.
    """
    dense = regs.copy()
    rows, places = np.nonzero(regs == _EMPTY)
    rng = np.random.default_rng(2024)
    for _ in range(64 * REGISTERS):
        if not len(rows):
            break
        donor = rng.integers(0, REGISTERS, REGISTERS)
        got = regs[rows, donor[places]]
        dense[rows, places] = got
        left = got == _EMPTY
        rows, places = rows[left], places[left]
    quads = np.ascontiguousarray(dense).view(np.uint64).reshape(len(regs), BANDS)
    return K.mix(quads ^ K.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(K._P)))


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, and the number of registers they rest on.

    Registers with the same zeros and mantissa by chance are taken off: two
    unrelated smallest values share both with a probability near 2^-MANTISSA / 3.
    """
    used = (a != _EMPTY) | (b != _EMPTY)
    n = used.sum(axis=1)
    return _corrected(((a == b) & used).sum(axis=1), n), n


def _corrected(same: np.ndarray, n: np.ndarray) -> np.ndarray:
    chance = n * (2.0**-MANTISSA / 3)
    return np.clip((same - chance) / np.maximum(n - chance, 1), 0, 1)


def _room(j: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    return j >= similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / np.maximum(n, 1)) - 1e-9


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, hash of the text, n_shingles, digest of the words, registers) per row."""

    def setup():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = _Shingles(texts, shingle)
            h, borders = found.hashed()
            regs = registers(h, borders)
            digest = [hashlib.blake2b(found.sequence(i), digest_size=16).digest() for i in range(len(texts))]
            return [pa.array(np.diff(borders).astype(np.int64)), pa.array(digest, pa.binary()), _binary(regs)]

        return work

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("regs", T.BinaryType())]
    rows = docs.select(col(key).alias("key"), F.xxhash64(col(text)).alias("text_hash"), col(text).alias("text"))
    return map_text(rows, "text", setup, fields, keep=["key", "text_hash"])


def _binary(rows: np.ndarray) -> pa.Array:
    """Equally long rows as a binary column."""
    size = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def _registers(column: pa.Array) -> np.ndarray:
    """A binary column of register rows, as numbers."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, REGISTERS), dtype=np.uint16)
    first = int(np.frombuffer(offsets, dtype=np.int32)[column.offset])
    return np.frombuffer(data, dtype=np.uint16, count=len(column) * REGISTERS, offset=first).reshape(-1, REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, doc): a row per band of every class."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                keys = band_keys(_registers(part.column(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["bucket", "doc"])

    return classes.select("node", "regs").mapInArrow(run, "bucket long, doc long")


def packed(docs: DataFrame) -> DataFrame:
    """(doc, z): texts as Zstandard, for shuffles."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for i, n in K.slices(b.column(1)):
                z = [pack.compress(x) for x in b.column(1).slice(i, n).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(z, pa.binary())], ["doc", "z"])

    return docs.mapInArrow(run, "doc long, z binary")


def texts_of(classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, z): a packed text of each class (node, rep: its smallest key and that row's hash)."""
    body = docs.select(col(key).alias("_key"), F.coalesce(col(text), F.lit("")).alias("text"))
    wanted = classes.select("node", "rep.key", "rep.text_hash").hint("merge")
    rows = body.join(wanted, (F.col("_key") == F.col("key")) & (F.xxhash64("text") == F.col("text_hash"))).select(F.col("node").alias("doc"), "text")
    # rows may repeat key and text
    return packed(rows).groupBy("doc").agg(F.first("z").alias("z"))


def _unpacked(z: list[bytes], shingle: int):
    """(first, number, hashes, borders) of packed texts, some SET_BYTES at a time."""
    unpack = zstandard.ZstdDecompressor()
    ends = np.cumsum([zstandard.frame_content_size(x) for x in z])
    i = 0
    while i < len(z):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SET_BYTES, side="right")))
        yield i, j - i, *shingle_sets(pa.array([unpack.decompress(x) for x in z[i:j]], pa.binary()), shingle)
        i = j


def _confirmed(one: bytes, others: list[bytes], shingle: int, percent: int) -> np.ndarray:
    """Which of the texts are linked with `one` by their words."""
    h, borders = _Shingles(pa.array([one, *others], pa.binary()), shingle).exact()
    return _linked(h[: borders[1]], h[borders[1] :], borders[1:] - borders[1], percent)


def _linked(one: np.ndarray, h: np.ndarray, borders: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets laid end to end in h have percent of their union with `one` in common."""
    common = K.per_text(one[np.minimum(np.searchsorted(one, h), len(one) - 1)] == h, borders)
    return 100 * common >= percent * (len(one) + np.diff(borders) - common)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| of their full sets.

    b is the hub.  A hub's set travels once to each of its salts, its partners
    spread over the salts; a task holds one hub's set at a time.
    """
    salts = max(16, min(1024, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    p = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int").alias("salt"))
    # texts always move by their key: a plan that broadcasts pairs would change with their number
    texts = texts.select("doc", "z").hint("merge")
    hubs = p.select("b", "salt").distinct().join(texts, F.col("b") == F.col("doc")).select("b", "salt", F.lit(0).alias("role"), "doc", "z")
    members = p.join(texts, F.col("a") == F.col("doc")).select("b", "salt", F.lit(1).alias("role"), "doc", "z")
    rows = hubs.union(members).repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches):
        hub, hub_z, unpack = np.zeros(0, dtype=np.uint64), b"", zstandard.ZstdDecompressor()
        for batch in batches:
            b, role, doc = (batch.column(i).to_numpy() for i in (0, 2, 3))
            z = batch.column(4).to_pylist()
            for i, n, h, borders in _unpacked(z, shingle):
                # a hub comes before its partners: runs between hubs
                at = np.flatnonzero(np.append(role[i : i + n] == 0, True))
                links = []
                for x, y in zip(np.append(-1, at[:-1]), at, strict=True):
                    if x >= 0:
                        hub, hub_z = h[borders[x] : borders[x + 1]].copy(), z[i + x]
                    if y > x + 1:
                        part = borders[x + 1 : y + 1]
                        good = i + x + 1 + np.flatnonzero(_linked(hub, h[part[0] : part[-1]], part - part[0], percent))
                        if len(good):
                            links.append(good[_confirmed(unpack.decompress(hub_z), [unpack.decompress(z[k]) for k in good], shingle, percent)])
                if links:
                    k = np.concatenate(links)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(b[k])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (bucket, doc) of buckets that hold several components, with each class's component."""
    marked = shared.join(labels, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("root", "doc").alias("comp"))
    several = marked.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(F.col("bucket").alias("_bucket"))
    return marked.join(several, F.col("bucket") == F.col("_bucket"), "left_semi")


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of open buckets with their registers, the numbers of cells (across, down), and whether
    they lie outside (out) their bucket's largest component."""
    side = classes.select(F.col("node").alias("_node"), "n_shingles", "regs")
    sizes = rows.join(side.drop("regs"), F.col("doc") == F.col("_node")).groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp", "w")).alias("m"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    blocks = lambda c, w: F.greatest(F.ceil(c / CELL), F.ceil(w / CELL_SHINGLES)).cast("int")
    sizes = sizes.select(
        F.col("bucket").alias("_bucket"), F.col("m.comp").alias("main"), blocks(F.col("c") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("across"), blocks(F.col("c"), F.col("w")).alias("down")
    )
    both = rows.join(sizes, F.col("bucket") == F.col("_bucket")).join(side, F.col("doc") == F.col("_node"))
    return both.select("bucket", "doc", "comp", (F.col("comp") != F.col("main")).alias("out"), "across", "down", "regs")


def _cells(members: DataFrame, *more: str) -> DataFrame:
    """Members dealt to the cells of their bucket: one outside the largest component (role 0) meets all (role 1)."""
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["doc", "comp", "out", "regs", *more]
    x = members.where("out").select("bucket", block("across").alias("i"), every("down").alias("j"), F.lit(0).alias("role"), *names)
    y = members.select("bucket", every("across").alias("i"), block("down").alias("j"), F.lit(1).alias("role"), *names)
    return x.union(y).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "role")


def _by_cell(batches, most: int = 4 * CELL):
    """Record batches that each hold whole cells (columns bucket, i, j first), of few rows where cells are small."""
    held: list[pa.RecordBatch] = []

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most)
            at += part.num_rows
            cell = np.column_stack([part.column(k).to_numpy() for k in range(3)])
            edge = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != int(cell[0, k]) for k in range(3)):
                yield joined()
                held = []
            if len(edge):
                held.append(part.slice(0, int(edge[-1])))
                yield joined()
                held = [part.slice(int(edge[-1]))]
            else:
                held.append(part)
    if held:
        yield joined()


def _pairs_in(batch: pa.RecordBatch, similarity: float, keys_of: Callable):
    """(rows x, rows y) of plausible pairs of two components, cell by cell; each pair in the first bucket that it shares only.

    A pair at exactly the similarity is dropped only if its estimate lies 4.5 standard deviations low.
    """
    bucket, i, j, role, doc, comp = (batch.column(k).to_numpy() for k in range(6))
    out = batch.column(6).to_numpy(zero_copy_only=False)
    regs = _registers(batch.column(7))
    keys = keys_of(regs).view(np.int64)
    edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    for a, z in zip(np.append(0, edge), np.append(edge, len(doc)), strict=True):
        mid = a + int(np.searchsorted(role[a:z], 1))
        ys = np.arange(mid, z)
        step = max(1, TESTS // max(1, len(ys)))
        for first in range(a, mid, step):
            xs = np.arange(first, min(first + step, mid))
            apart = (comp[xs][:, None] != comp[ys]) & (~out[ys] | (doc[xs][:, None] < doc[ys]))
            x, y = np.nonzero(apart)
            x, y = xs[x], ys[y]
            est, n = estimate(regs[x], regs[y])
            keep = _room(est, n, similarity)
            x, y = x[keep], y[keep]
            same = keys[x] == keys[y]
            here = np.take_along_axis(keys[x], same.argmax(axis=1)[:, None], 1)[:, 0] == bucket[a] if len(x) else np.zeros(0, dtype=bool)
            if here.any():
                yield x[here], y[here]


def _plausible(cells: DataFrame, similarity: float) -> DataFrame:
    """(bucket, doc): members with a plausible partner."""

    def run(batches):
        for batch in _by_cell(batches):
            rows = [k for pair in _pairs_in(batch, similarity, band_keys) for k in pair]
            if rows:
                at = pa.array(np.unique(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(4).take(at)], ["bucket", "doc"])

    return cells.mapInArrow(run, "bucket long, doc long").distinct()


def _verified_cells(cells: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between components: of a member's links with one component in a cell, one."""

    def run(batches):
        for batch in _by_cell(batches):
            pairs = list(_pairs_in(batch, percent / 100, band_keys))
            if not pairs:
                continue
            x, y = (np.concatenate(side) for side in zip(*pairs, strict=True))
            doc, comp = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            # a class lies in many cells of the batch: its set is made once
            who, place = np.unique(doc, return_index=True)
            used = np.zeros(len(who), dtype=bool)
            x, y = np.searchsorted(who, doc[x]), np.searchsorted(who, doc[y])
            used[x] = used[y] = True
            z = batch.column(8).take(pa.array(place[used])).to_pylist()
            unpack = zstandard.ZstdDecompressor()
            sets = [h[b[k] : b[k + 1]].copy() for _, n, h, b in _unpacked(z, shingle) for k in range(n)]
            at = np.cumsum(used) - 1
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            edges = np.flatnonzero(np.diff(x, prepend=-1))
            links = []
            for a, b in zip(edges, np.append(edges[1:], len(x)), strict=True):
                ys, one = y[a:b], sets[at[x[a]]]
                for k in range(0, len(ys), 256):
                    some = [sets[at[v]] for v in ys[k : k + 256]]
                    good = ys[k : k + 256][_linked(one, np.concatenate(some), np.cumsum([0, *map(len, some)]), percent)]
                    if len(good):
                        good = good[_confirmed(unpack.decompress(z[at[x[a]]]), [unpack.decompress(z[at[v]]) for v in good], shingle, percent)]
                    _, first = np.unique(comp[place[good]], return_index=True)
                    links += [(who[x[a]], who[v]) for v in good[first]]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links, strict=True)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: (key, n_shingles, component_id, kept).

    Documents are linked if their shingle sets have at least `percent` percent
    in common; component_id is the smallest key reachable, kept marks it.
    Empty, null and wordless texts are linked with nothing.  Rows that repeat a
    key are one document: all their texts' links count.  A null key has a null
    component and is kept.  Keys may be of any type that can be ordered.
    """
    sig = cut(signatures(docs, key, text, shingle), "signatures")
    full = sig.where(F.col("key").isNotNull() & (F.col("n_shingles") > 0))
    # numbers given once and written: a class of equal words is its number from here on
    classes = full.groupBy("digest").agg(F.min(F.struct("key", "text_hash")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = cut(sig.select("key", "n_shingles", F.when(F.col("key").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest")).join(classes.select("digest", "node"), "digest", "left").drop("digest"), "member")

    spread = bands(classes)
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "_bucket")
    shared = cut(spread.join(counts, F.col("bucket") == F.col("_bucket")).select("bucket", "doc", "n"), "buckets")
    several = classes.select("node", "rep").join(shared.select(F.col("doc").alias("_doc")).distinct(), F.col("node") == F.col("_doc"), "left_semi")
    texts = cut(texts_of(several, docs, key, text), "texts")

    # a class's score is the size of all its buckets: one with few edits has the largest of its group
    score = shared.groupBy("doc").agg(F.sum("n").alias("score")).withColumnRenamed("doc", "_doc")
    scored = shared.join(score, F.col("doc") == F.col("_doc")).select("bucket", "doc", "score")
    hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", "doc")).alias("hub")).withColumnRenamed("bucket", "_bucket")
    stars = shared.join(hubs, F.col("bucket") == F.col("_bucket")).groupBy("doc").agg(F.max("hub").alias("hub"))
    stars = stars.select(F.col("doc").alias("a"), F.col("hub.doc").alias("b")).where("a <> b")
    stars = cut(verified(stars, texts, shingle, percent), "stars")
    labels = roots(stars)

    rows = cut(_open(shared, labels), "open")
    members = cut(_members(rows, classes), "members")
    wanted = _plausible(_cells(members), percent / 100).withColumnRenamed("bucket", "_bucket").withColumnRenamed("doc", "_doc")
    wanted = cut(members.join(wanted, (F.col("bucket") == F.col("_bucket")) & (F.col("doc") == F.col("_doc")), "left_semi"), "wanted")
    held = wanted.join(texts.select(F.col("doc").alias("_doc"), "z").hint("merge"), F.col("doc") == F.col("_doc")).drop("_doc")
    links = cut(_verified_cells(_cells(held, "z"), shingle, percent), "links")

    # rows of one key with several sets link these; all links lie between roots, to which the smallest key is joined at the end
    sets = member.where("node is not null").groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select(F.col("key").alias("_key"), "low")
    again = member.join(sets, F.col("key") == F.col("_key")).select(F.col("node").alias("a"), F.col("low").alias("b")).where("a <> b")
    every = links.union(again).distinct()
    for side in "ab":
        every = every.join(labels.select(F.col("node").alias("_node"), "root"), F.col(side) == F.col("_node"), "left").withColumn(side, F.coalesce("root", side)).select("a", "b")
    comps = cut(components(every), "components")
    ends = classes.select("node", F.col("rep.key").alias("rep")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = ends.join(comps.select(F.col("node").alias("_node"), "component"), F.col("root") == F.col("_node"), "left").select("node", "rep", F.coalesce("component", "root").alias("comp"))
    ends = cut(ends, "ends")
    for done in (sig, classes, shared, texts, stars, labels, rows, members, wanted, links, comps):
        drop_cut(done)
    least = ends.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1").select(F.col("comp").alias("_comp"), "component_id")
    ends = ends.join(least, F.col("comp") == F.col("_comp"), "left").select(F.col("node").alias("_node"), F.coalesce("component_id", "rep").alias("component_id"))
    out = member.join(ends, F.col("node") == F.col("_node"), "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_near_dedup(spark, sf_dir):
    """Components of near-duplicate documents, on four-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4)
