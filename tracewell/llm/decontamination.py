"""Benchmark decontamination with a broadcast set of normalised n-grams.

The n-grams of the benchmark are few; they go to every task as a sorted hash
array.  Each task scans its texts' windows against it, confirms each hit on
the bytes, and marks the words inside.  No shuffle, whatever the texts are.
A benchmark with more n-grams than `block_ngrams` is scanned in blocks of
bounded size, one pass of the same scan for each.  A pass is written before
the next block is broadcast and the last one given up, so what is broadcast at
once never grows with the tables.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm.frames import col, cut, drop_cut, lower_ascii, map_text, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_NGRAMS = 500_000

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def benchmark_ngrams(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """One row per (n-gram, item): item (string), gram (words joined by a space), n.

    An item of fewer than n words, but not none, is one n-gram.  Rows with a
    null text give none; those of a null item mark words, but name no item.
    """
    words = benchmark.where(col(text).isNotNull()).select(
        col(item).cast("string").alias("item"), F.regexp_extract_all(lower_ascii(col(text)), F.lit(WORD), 0).alias("w")
    )
    size = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    return (
        words.where(size > 0)
        .select("item", F.least(size, F.lit(n)).alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
        .distinct()
    )


class _Grams:
    """A block of n-grams for the scan: hashes sorted by length, with the bytes and items behind each."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        items = defaultdict(set)
        for item, gram in rows:
            items[gram.encode()].add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[tuple[bytes, list[str]]]]]] = {}
        lengths = defaultdict(list)
        for gram in items:
            lengths[gram.count(b" ") + 1].append(gram)
        for n, grams in lengths.items():
            c = K.chunk(pa.array(grams, pa.binary()))
            starts, ends, before = c.words(K.ALNUM)
            _, hashes = K.windows(K.spans_hash(c.bytes_prefix(), starts, ends), before, n)
            found = defaultdict(list)
            for h, g in zip(hashes.tolist(), grams, strict=True):
                found[h].append((g, sorted(items[g] - {None})))
            self.by_length[n] = (np.unique(hashes), dict(found))

    def scan(self, texts: pa.Array):
        """Words of each text, marked words, and the items found in each."""
        c = K.chunk(texts)
        low = K.LOWER[c.data]
        starts, ends, before = c.words(K.ALNUM)
        mask = np.zeros(len(starts), dtype=bool)
        found: list[set[str]] = [set() for _ in range(len(texts))]
        word = K.spans_hash(c.bytes_prefix(low), starts, ends)
        for n, (wanted, grams) in self.by_length.items():
            at, h = K.windows(word, before, n)
            place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = np.flatnonzero(wanted[place] == h)
            of = np.searchsorted(before, at[hit], side="right") - 1
            for i, value, text in zip(at[hit].tolist(), h[hit].tolist(), of.tolist(), strict=True):
                said = b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + n))
                for gram, items in grams[value]:
                    if gram == said:
                        mask[i : i + n] = True
                        found[text].update(items)
        return c, starts, ends, before, mask, found


_held: dict[str, _Grams] = {}


def _built(name: str, sent) -> _Grams:
    """The block's tables, built once in a worker and kept for its next tasks."""
    if name not in _held:
        _held.clear()
        _held[name] = _Grams(sent.value)
    return _held[name]


def _blocks(grams: DataFrame, most: int) -> tuple[list[tuple[int, int]], Column]:
    """Ranges of shares with at most `most` rows in each, and the share of a row.

    Rows are dealt by n-gram and item, so the items of an n-gram that stands in many of them spread
    over the blocks: each block marks its words, and together they name all its items.
    """
    total = grams.count()
    shares = max(1, 16 * -(-total // most)) if total > most else 1
    while True:
        share = F.pmod(F.xxhash64("gram", "item"), F.lit(shares))
        # a row per share
        sizes = {r["s"]: r["n"] for r in grams.groupBy(share.alias("s")).agg(F.count("*").alias("n")).collect()}
        if max(sizes.values(), default=0) <= most:
            break
        shares *= 2
    out, low, held = [], 0, 0
    for s in range(shares):
        if held + sizes.get(s, 0) > most:
            out.append((low, s - 1))
            low, held = s, 0
        held += sizes.get(s, 0)
    return [*out, (low, shares - 1)], share


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    n: int = 10,
    block_ngrams: int = BLOCK_NGRAMS,
    keep: list[str] | None = None,
    left: str | None = None,
) -> DataFrame:
    """Add to each row: n_words, spans (hit word ranges [start, end), merged) and items (found item ids, sorted).

    With `left`, what is left of the text without the hit words is added under that name.

    Null and empty texts have no words.  Every row is judged alone, so
    repeated rows and ties all get the same marks.
    """
    grams = cut(benchmark_ngrams(benchmark, item, "text", n), "ngrams")
    limits, share = _blocks(grams, block_ngrams)
    blocks = len(limits)
    at_once = left is not None and blocks == 1  # a second pass of Python in one stage would hold a second worker for each core
    out = docs.select(*[col(c) for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items")], *([] if keep is None or text in keep else [col(text)]))
    for b, (low, high) in enumerate(limits):
        # at most block_ngrams rows of n words each
        rows = [(r["item"], r["gram"]) for r in grams.where(share.between(low, high)).select("item", "gram").collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def setup(sent=sent, name=uuid.uuid4().hex):
            block = _built(name, sent)

            def work(texts: pa.Array) -> list[pa.Array]:
                c, starts, ends, before, mask, found = block.scan(texts)
                first, last = K.runs(mask, before)
                of = np.searchsorted(before, first, side="right") - 1
                base = before[of]
                spans = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["start", "end"])
                made = [
                    pa.array(np.diff(before)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), spans),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ]
                return [*made, _left(texts, c, starts, ends, before, made[1])] if at_once else made

            return work

        fields = [T.StructField("n_words", T.LongType()), T.StructField(f"spans{b}", _SPAN), T.StructField(f"items{b}", T.ArrayType(T.StringType())), *([T.StructField(left, T.StringType())] if at_once else [])]
        out = map_text(out, text, setup, fields)
        if b + 1 < blocks or (left is not None and not at_once):
            before, out = out, cut(out, "marked")
            if b:
                drop_cut(before)
            sent.destroy()
    spans = [f"spans{b}" for b in range(blocks)]
    items = [f"items{b}" for b in range(blocks)]
    rest = [col(c) for c in out.columns if c not in (*spans, *items)]
    if blocks == 1:
        return out.select(*rest, F.col("spans0").alias("spans"), F.col("items0").alias("items"))
    out = out.select(*rest, merged(F.concat(*spans)).alias("spans"), F.array_sort(F.array_distinct(F.concat(*items))).alias("items"))
    return out if left is None else _with_left(out, text, left)


def _left(texts: pa.Array, c: K.Chunk, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans."""
    out = []
    for i, cuts in enumerate(spans.to_pylist()):
        if not cuts:
            out.append(texts[i].as_py())
            continue
        pos, parts = int(c.offsets[i]), []
        for s in cuts:
            parts.append(c.data[pos : starts[before[i] + s["start"]]].tobytes())
            pos = int(ends[before[i] + s["end"] - 1])
        parts.append(c.data[pos : c.offsets[i + 1]].tobytes())
        out.append(b"".join(parts).decode())
    return pa.array(out, pa.string())


def _with_left(marked: DataFrame, text: str, left: str) -> DataFrame:
    schema = T.StructType([*marked.schema.fields, T.StructField(left, T.StringType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for first, size in K.slices(batch.column(at)):
                part = batch.slice(first, size)
                c = K.chunk(part.column(at))
                made = _left(part.column(at), c, *c.words(K.ALNUM), part.column(batch.schema.get_field_index("spans")))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [f.name for f in schema])

    return marked.mapInArrow(run, schema)


def merged(spans: Column) -> Column:
    """Overlapping or touching ranges become one."""

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), step)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows without any hit; the columns of `docs`."""
    marked = mark(docs, benchmark, text, **options)
    return marked.where(F.size("spans") == 0).select(*[col(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` with the hit words cut out of their texts.

    From the first to the last character of each run of hit words is removed;
    all other characters stay, and a null text stays null.
    """
    marked = mark(docs, benchmark, text, left="__left", **options)
    return marked.select(*[F.col("__left").alias(c) if c == text else col(c) for c in docs.columns])


def op6_decontamination(spark, sf_dir):
    """Words and items of `benchmark` in every document."""
    marked = mark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
