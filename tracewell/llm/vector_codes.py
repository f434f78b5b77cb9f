"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Vectors become whole numbers and are cut into parts.  Each part position has a
codebook of a few entries, refined in rounds: every part goes to its nearest
entry, then entries become the floored means of their parts.  A round is one
scan of the vectors; tasks send one row per codebook component, so what is
shuffled and what reaches the driver has the size of the codebooks, whatever
the number of vectors.  Sums of whole numbers don't depend on the order of
rows, so a rerun task changes nothing.

Equal-average search: entries are sorted by the sum of their components.  With
w components a part of sum s and an entry of sum t are at least (s - t)^2 / w
apart, so the search goes outward from s and stops where the squared gap over
w strictly exceeds the best distance; ties still meet and the lower index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.frames import col, cut, read
from tracewell.llm.vectors import scaled
from tracewell.sources.shared import SALTS, SMALL_ROWS

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_LAST = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """Entries as whole numbers (parts x entries x components of a part)."""

    entries: np.ndarray
    scale: int

    def __post_init__(self):
        sums = self.entries.sum(axis=2)
        self._order = np.argsort(sums, axis=1, kind="stable")
        self._sums = np.take_along_axis(sums, self._order, 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance (rows x parts)."""
        parts, _, width = self.entries.shape
        if x.shape[1] != parts * width:
            raise ValueError(f"a vector of {x.shape[1]} components for codebooks of {parts * width}")
        found = [self._search(p, x[:, p * width : (p + 1) * width]) for p in range(parts)]
        return np.column_stack([i for i, _ in found]), np.column_stack([d for _, d in found])

    def _search(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, sums, entries = self._order[part], self._sums[part], self.entries[part]
        own = x.sum(axis=1)
        index, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), _LAST)
        right = np.searchsorted(sums, own)
        left, rows = right - 1, np.arange(len(x))
        while len(rows):
            down = np.where(left >= 0, own[rows] - sums[np.maximum(left, 0)], _LAST)
            up = np.where(right < len(sums), sums[np.minimum(right, len(sums) - 1)] - own[rows], _LAST)
            gap = np.minimum(down, up)
            # a sum of w components below 2^27: its square fits; the bound is compared without division
            some = gap != _LAST
            some[some] = gap[some] ** 2 <= x.shape[1] * np.minimum(best[rows[some]], _LAST // x.shape[1])
            rows, left, right, go_up = rows[some], left[some], right[some], (up < down)[some]
            at = order[np.where(go_up, right, left)]
            away = ((x[rows] - entries[at]) ** 2).sum(axis=1)
            better = (away < best[rows]) | ((away == best[rows]) & (at < index[rows]))
            index[rows[better]], best[rows[better]] = at[better], away[better]
            right, left = right + go_up, left - ~go_up
        return index, best


def _first_vectors(rows: DataFrame, scale: int, n: int) -> list[tuple[int, list[int]]]:
    """The n smallest keys with their whole vectors; of rows of one key the smallest vector counts, null keys come last as one."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        least: list[tuple[int, tuple[int, ...]]] = []
        for b in batches:
            kept, x = scaled(b.column(1), scale)
            keys = b.column(0).cast(pa.int64()).fill_null(int(_LAST)).to_numpy()[kept]
            near = np.flatnonzero(keys <= (least[-1][0] if len(least) == n else _LAST))
            # of each key all rows, so that the smallest vector is among them
            near = near[np.isin(keys[near], np.unique(keys[near])[:n])]
            by_key: dict[int, tuple[int, ...]] = {}
            for k, v in [*least, *zip(keys[near].tolist(), map(tuple, x[near].tolist()), strict=True)]:
                by_key[k] = min(v, by_key.get(k, v))
            least = sorted(by_key.items())[:n]
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in least]), pa.array([list(v) for _, v in least], pa.list_(pa.int64()))], ["k", "v"])

    found = rows.mapInArrow(run, "k long, v array<long>").groupBy("k").agg(F.min("v").alias("v")).orderBy("k").limit(n)
    return [(r.k, list(r.v)) for r in found.collect()]


def _means(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries as the floored means of the parts nearest to them; unused ones stay."""
    shape = books.entries.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for b in batches:
            kept, x = scaled(b.column(0), books.scale)
            if len(kept):
                at, _ = books.nearest(x)
                for p in range(shape[0]):
                    np.add.at(sums[p], at[:, p], x[:, p * shape[2] : (p + 1) * shape[2]])
                    n[p] += np.bincount(at[:, p], minlength=shape[1])
        of = np.repeat(n.ravel(), shape[2])
        used = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(of[used]), pa.array(sums.ravel()[used])], ["slot", "n", "total"])

    wide = T.DecimalType(38, 0)
    found = rows.select("v").mapInArrow(run, "slot long, n long, total long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(wide)).alias("total"))
    flat = books.entries.ravel().copy()
    for r in found.collect():  # one row per codebook component at most
        flat[r.slot] = int(r.total) // r.n
    return flat.reshape(shape)


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all vectors of `df`; None if it has no whole vector.

    They start as the parts of the `entries` smallest keys (whole numbers; rows
    that repeat a key count as one here, null keys come last).  Rows whose
    vector is null, empty, or holds null or non-finite components take no part.
    With fewer keys the codebooks have fewer entries.
    """
    rows = df.select(col(key).alias("k"), col(vector).alias("v"))
    first = [v for _, v in _first_vectors(rows, scale, entries)]
    if not first:
        return None
    if len({len(v) for v in first}) > 1 or len(first[0]) % parts:
        raise ValueError(f"vectors of {sorted({len(v) for v in first})} components can't be cut into {parts} equal parts")
    start = np.array(first, dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start), scale)
    for _ in range(rounds):
        books = Codebooks(_means(rows, books), scale)
    return books


def encode(df: DataFrame, books: Codebooks | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """One row per whole vector: the columns in `keep` (default: all but `vector`), code, error.

    code: two hex digits per part; error: squared distances to the entries, summed over the parts.
    Kept columns named code or error are replaced.  Rows without a whole vector are left out; a
    row is coded alone, so repeated rows get the same code.  Without codebooks there is no row.
    """
    kept_names = [c for c in (df.columns if keep is None else keep) if c not in ("code", "error") and (keep is not None or c != vector)]
    source = df.select(*[col(c) for c in kept_names], col(vector).alias("__vector"))
    schema = T.StructType([*(source.schema[i] for i in range(len(kept_names))), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = scaled(b.column(len(kept_names)), books.scale)
            if not len(kept):
                continue
            at, away = books.nearest(x)
            digits, size = at.astype(np.uint8).tobytes().hex(), 2 * at.shape[1]
            codes = [digits[i : i + size] for i in range(0, len(digits), size)]
            rest = b.take(pa.array(kept)).columns[: len(kept_names)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(codes, pa.string()), pa.array(away.sum(axis=1))], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add label_error: the errors summed over rows of one label; rows without a label are one group.

    Sums are made before the join.  Those of at most SMALL_ROWS labels are broadcast; more are
    joined under salts, so that a label with a third of all rows is no hot task.
    """
    sums = coded.groupBy(col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    same = col(label).eqNullSafe(F.col("_label"))
    plain = coded.drop("label_error")
    if sums.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return plain.join(F.broadcast(sums), same).drop("_label")
    spread = plain.withColumn("_salt", F.pmod(F.xxhash64(*[col(c) for c in plain.columns]), F.lit(SALTS)).cast("int"))
    salted = sums.withColumn("_own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(salted, same & (F.col("_salt") == F.col("_own_salt"))).drop("_label", "_salt", "_own_salt")


def op11_vector_codes(spark, sf_dir):
    """Product codes of every whole vector of `embeddings`."""
    rows = read(spark, sf_dir, "embeddings")
    books = fit(rows)
    coded = cut(encode(rows, books, keep=["vec_id", "label"]), "codes")
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return with_group_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
