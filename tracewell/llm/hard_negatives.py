"""Hard-negative mining with Fagin's threshold algorithm.

Rows are dealt to shards by a hash of their key, anchors to blocks; a task holds
one shard and one block of anchors (a stated query set against all rows, in
blocks: no pair leaves a task that isn't among an anchor's best there).  In a
shard every dimension has its candidates sorted by component.  An anchor walks
all lists at once, downward where its own component is positive and upward where
it is negative (zero ones add nothing), looks up the whole vector of every row
that it meets and scores it in whole numbers.  The components at the current
depth give the threshold: no row that was not met yet can score more.  The walk
stops once the threshold lies strictly below the k-th score of every window, or
below the window itself.

Two passes: the best rows of the anchor's own label give its positives, each
positive's score gives a window, and the best rows of other labels in each
window are the negatives.  A label, however large, is never gathered: shards are
cut across labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.frames import col, cut, drop_cut, read
from tracewell.llm.vectors import scaled

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
SHARD_ROWS, BLOCK_ANCHORS = 1 << 14, 1 << 12
FIRST_DEPTH = 64
_EXACT = 1 << 53  # doubles hold whole numbers below


class Lists:
    """Rows (key ascending) with every dimension sorted by component."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.keys, self.labels, self.x = keys, labels, x
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(x.T, self.order, 1))
        # products of doubles are exact and faster while all sums stay below 2^53
        self.most = int(np.abs(x).max(initial=0)) * x.shape[1]
        self.doubles = x.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(anchor).max()) < _EXACT:
            return (self.doubles[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor

    def best(self, anchor: np.ndarray, k: int, windows: list[tuple[int, int]] | None, allowed: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) on 100 times the score, or one open window: rows and scores of the k best allowed rows.

        Scores come in falling order, equal ones by key.
        """
        n = len(self.keys)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, met = np.zeros(n, dtype=bool), [np.zeros(0, dtype=np.int64)]
        score, scores = np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, depth = 0, FIRST_DEPTH
        if not len(up) and not len(down):  # a zero anchor scores 0 with all
            met, done = [np.arange(n) if allowed is None else np.flatnonzero(allowed)], n
            scores = score[met[0]]
        while done < n:
            to = min(depth, n)
            new = np.zeros(n, dtype=bool)
            new[self.order[up, n - to : n - done].ravel()] = True
            new[self.order[down, done:to].ravel()] = True
            new &= ~seen
            seen |= new
            rows = np.flatnonzero(new if allowed is None else new & allowed)
            score[rows] = self.scores(rows, anchor)
            met.append(rows)
            scores = np.concatenate([scores, score[rows]])
            done, depth = to, 2 * to
            if done < n:
                threshold = int(anchor[up] @ self.values[up, n - done] + anchor[down] @ self.values[down, done - 1])
                if all(self._settled(scores, threshold, k, w) for w in (windows or [None])):
                    break
        rows = np.concatenate(met)
        out = []
        for w in windows or [None]:
            inside = slice(None) if w is None else (100 * scores >= w[0]) & (100 * scores <= w[1])
            of, s = rows[inside], scores[inside]
            if len(s) > k:
                top = s >= np.partition(s, len(s) - k)[len(s) - k]
                of, s = of[top], s[top]
            order = np.lexsort((of, -s))[:k]
            out.append((of[order], s[order]))
        return out

    @staticmethod
    def _settled(scores: np.ndarray, threshold: int, k: int, window: tuple[int, int] | None) -> bool:
        if window is not None:
            if 100 * threshold < window[0] or window[1] < window[0]:
                return True
            if 100 * threshold >= window[1]:  # no k-th score lies above
                return False
            scores = scores[(100 * scores >= window[0]) & (100 * scores <= window[1])]
        return len(scores) >= k and threshold < int(np.partition(scores, len(scores) - k)[len(scores) - k])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors that travel as 32-bit numbers in bytes."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(len(column), -1).astype(np.int64)


def _shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels and vectors of a shard, a row per key: of rows that share one, that of the smallest label, then vector."""
    keys, labels = table.column("key").to_numpy(), table.column("label").to_numpy()
    order = np.lexsort((labels, keys))
    if len(np.unique(keys)) < len(keys):
        packed = table.column("v").to_pylist()
        order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], labels[i], packed[i])))
        order = order[np.append(True, keys[order][1:] != keys[order][:-1])]
    return keys[order], labels[order], _matrix(table.column("v"))[order]


def prepared(df: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(key, label, v): rows with a key, a label and a whole vector; v holds floor(scale * x) as 32-bit numbers."""
    rows = df.select(col(key).cast("long").alias("key"), label.cast("long").alias("label"), col(vector).alias("v")).where("key is not null and label is not null")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = scaled(b.column(2), scale)
            if len(kept):
                rest = b.take(pa.array(kept)).columns[:2]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())], ["key", "label", "v"])

    return rows.mapInArrow(run, "key long, label long, v binary")


def _meet(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, work, schema: str) -> DataFrame:
    """Every block of anchors with every shard of rows, one cell a task: work(shard, anchors) -> pa.Table."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = rows.select(dealt(shards).alias("shard"), every(blocks).alias("block"), "key", "label", "v")
    right = anchors.select(every(shards).alias("shard"), dealt(blocks).alias("block"), "*")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(work, schema)


def mine(
    df: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    shard_rows: int = SHARD_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """One row per anchor, positive and negative: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` is a condition on `key` (a whole number).  Scores are inner products of floor(scale * x);
    higher ones come first, ties by smaller key.  Negatives have another label and a score between
    `low` and `high` percent of the positive's.  Rows with a null key or label, or without a whole
    vector, take no part.  Rows that repeat a key are one (smallest label, then vector), and no
    row is its own positive.  Without anchors, or with an empty table, there is no row.
    """
    rows = cut(prepared(df, key, col(label) if isinstance(label, str) else label, vector, scale), "vectors")
    least = rows.withColumnRenamed("key", key).where(anchors).groupBy(col(key).alias("key")).agg(F.min(F.struct("label", "v")).alias("m"))
    chosen = cut(least.select("key", "m.label", "m.v"), "anchors")
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    # at most shard_rows rows in a shard on average; more shards only while cores would idle
    shards = max(1, -(-n // shard_rows), min(cores, -(-n // max(1, shard_rows // 8))))
    blocks = max(1, -(-chosen.count() // block_anchors))

    def own_label(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if shard.num_rows and block.num_rows:
            keys, labels, x = _shard(shard)
            ids, of, vectors = block.column("key").to_numpy(), block.column("label").to_numpy(), _matrix(block.column("v"))
            for value in np.unique(of):
                at = np.flatnonzero(labels == value)
                if not len(at):
                    continue
                lists = Lists(keys[at], labels[at], x[at])
                for i in np.flatnonzero(of == value):
                    others = lists.keys != ids[i]
                    ((found, s),) = lists.best(vectors[i], positives, None, None if others.all() else others)
                    out += zip([int(ids[i])] * len(s), lists.keys[found].tolist(), s.tolist(), strict=True)
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    ranked = lambda *by: F.row_number().over(Window.partitionBy("anchor_id", *by[:-2]).orderBy(F.col(by[-2]).desc(), by[-1]))
    found = _meet(rows, chosen, shards, blocks, own_label, "anchor_id long, positive_id long, positive_score long")
    found = found.withColumn("rank", ranked("positive_score", "positive_id")).where(F.col("rank") <= positives)
    # at most `positives` a key
    windows = found.groupBy(F.col("anchor_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("windows"))
    asked = cut(chosen.join(windows, F.col("key") == F.col("_id")).drop("_id"), "windows")

    def other_labels(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if shard.num_rows and block.num_rows:
            lists = Lists(*_shard(shard))
            ids, of, vectors = block.column("key").to_numpy(), block.column("label").to_numpy(), _matrix(block.column("v"))
            apart = {value: lists.labels != value for value in np.unique(of)}
            for i, held in enumerate(block.column("windows").to_pylist()):
                spans = [(low * w["positive_score"], high * w["positive_score"]) for w in held]
                for w, (at, s) in zip(held, lists.best(vectors[i], negatives, spans, apart[of[i]]), strict=True):
                    out += zip([int(ids[i])] * len(s), [w["positive_id"]] * len(s), lists.keys[at].tolist(), [w["positive_score"]] * len(s), s.tolist(), strict=True)
        return _table(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    hard = _meet(rows, asked, shards, blocks, other_labels, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    hard = hard.withColumn("rank", ranked("positive_id", "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    hard = cut(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for table in (rows, chosen, asked):
        drop_cut(table)
    return hard


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table({name: pa.array(list(c), pa.int64()) for name, c in zip(names, columns, strict=True)})


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every 50th row of `embeddings`; labels of every 7th row are shifted by one."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label=label)
