"""Quality rules: exact rule statistics per document, and an isolation forest on them.

The statistics come from one pass without a shuffle.  The forest is fitted on
half of all labelled rows, each of which takes part: they are dealt to the
trees, and a level of all trees is grown from one grouped minimum and maximum.
Documents far from the well-written ones are isolated by few random splits, so
their paths are short.  The threshold is calibrated on the other half, over the
whole distribution of its scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm.frames import col, map_text, read, small_table
from tracewell.sources.shared import written

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_distinct_words"]

#: Trees of a forest, and the rows that each gets at least, as long as there are so many.
N_TREES, TREE_ROWS = 128, 256
#: Scores are counted in so many buckets, whose totals the driver sums up.
SCORE_BUCKETS = 4096
_RATES = [f"_x{i}" for i in range(5)]

_LINE = K.separators((0x0A, 0x0A))


def _is(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(x) for x in chars]] = True
    return table


_SYMBOL, _UPPER, _STOP = _is("#*$%&|<>"), _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is(".!?")
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first bytes of code points


def _by_text(ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers told apart by text too."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before)) * (np.int64(ids.max(initial=0)) + 1) + ids


def text_stats(texts: pa.Array) -> list[np.ndarray]:
    """The STATS of each text; null and empty texts have zeros."""
    c = K.chunk(texts)
    starts, ends, before = c.words(K.SPACED)
    word = K.exact_ids(c.data, starts, ends, K.word_hash(c.data, starts, ends))
    in_word = K.SPACED[c.data]

    lines, line_ends, line_before = c.words(_LINE)
    filled = np.zeros(len(c.data) + 1, dtype=np.int64)
    np.cumsum(in_word, out=filled[1:])
    real = filled[line_ends] > filled[lines]
    real_before = np.concatenate([[0], np.cumsum(real)])[line_before]
    lines, line_ends = lines[real], line_ends[real]
    line = K.exact_ids(c.data, lines, line_ends, K.word_hash(c.data, lines, line_ends))
    _, first = np.unique(_by_text(line, real_before), return_index=True)
    new_line = np.zeros(len(lines), dtype=bool)
    new_line[first] = True

    repeat = np.zeros(len(word), dtype=bool)
    counts = np.maximum(np.diff(before) - 2, 0)
    at = K.ragged(before[:-1], counts)
    if len(at):
        code = K.exact_windows(word, at, np.full(len(at), 3), 3)
        _, back, n = np.unique(_by_text(code, np.concatenate([[0], np.cumsum(counts)])), return_inverse=True, return_counts=True)
        again = at[n[back] > 1]
        repeat = K.cover(len(word), again, again + 3)
    _, first = np.unique(_by_text(word, before), return_index=True)
    new_word = np.zeros(len(word), dtype=bool)
    new_word[first] = True
    n_lines = np.diff(real_before)
    return [
        np.diff(before),
        K.per_text(in_word & _LEAD[c.data], c.offsets),
        K.per_text(_SYMBOL[c.data], c.offsets),
        n_lines - K.per_text(new_line, real_before),
        K.per_text(repeat, before),
        n_lines,
        K.per_text(_UPPER[c.data], c.offsets),
        K.per_text(_STOP[c.data], c.offsets),
        K.per_text(new_word, before),
    ]


def rule_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the STATS as long columns (columns of these names are replaced).

    Words are runs of characters other than space, tab and line breaks.
    Lines, words and windows are equal where their bytes are.  Every row is
    judged alone: repeated rows get equal statistics.
    """
    fields = [T.StructField(s, T.LongType()) for s in STATS]
    return map_text(df, text, lambda: lambda texts: [pa.array(x.astype(np.int64)) for x in text_stats(texts)], fields, keep)


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that don't depend on the length, from a matrix of STATS: characters
    a word, symbols a word, words in repeats, capitals a character, variety."""
    s = stats.astype(np.float64)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return np.column_stack([s[:, 1] / words, s[:, 2] / words, s[:, 4] / words, s[:, 6] / chars, np.log1p(s[:, 8]) / np.log1p(words)])


#: Fewer than 50 words, or over half of them in repeated three-word windows.
_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Growing:
    """Trees that grow together, a level at a time, from the sizes and borders of their open nodes.

    Nodes of all trees lie in flat arrays: feature (-1: leaf), cut, left child (right is the next), tree, path length.
    """

    def __init__(self, n_trees: int, rows: float, seed: int):
        self.n_trees, self.rows, self.seed = n_trees, rows, seed
        self.depth, self.deepest = 0, max(1, math.ceil(math.log2(max(2, min(TREE_ROWS, rows)))))
        self.feature, self.left = np.full(n_trees, -1), np.zeros(n_trees, dtype=np.int64)
        self.cut, self.path = np.zeros(n_trees), np.zeros(n_trees)
        self.tree, self.newest = np.arange(n_trees), 0

    def place(self, tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The node that each row has reached in its tree."""
        node, index = np.array(tree, dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            node = np.where(f >= 0, self.left[node] + (x[index, np.maximum(f, 0)] > self.cut[node]), node)
        return node

    def split(self, node: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
        """Split the newest nodes at random, given their rows' number and borders; False once the trees are grown."""
        order = np.argsort(node)
        node, count, low, high = node[order], count[order], low[order], high[order]
        rng = np.random.default_rng([self.seed, self.depth])
        f = np.where(high > low, 1 + rng.random(low.shape), 0.0).argmax(axis=1)
        at = np.arange(len(node))
        u = rng.random(len(node))
        cut = low[at, f] + u * (high[at, f] - low[at, f])
        inner = (count > 1) & (high > low).any(axis=1) & (self.depth < self.deepest)
        self.path[node] = self.depth + np.array([0.0 if i else _mean_path(n) for i, n in zip(inner.tolist(), count.tolist(), strict=True)])
        split = node[inner]
        self.newest = len(self.feature)
        self.feature[split], self.cut[split], self.left[split] = f[inner], cut[inner], self.newest + 2 * np.arange(len(split))
        new = 2 * len(split)
        self.depth += 1
        # a side that no row reaches (rounding) is a leaf
        self.feature, self.left = np.append(self.feature, np.full(new, -1)), np.append(self.left, np.zeros(new, dtype=np.int64))
        self.cut, self.path = np.append(self.cut, np.zeros(new)), np.append(self.path, np.full(new, float(self.depth)))
        self.tree = np.append(self.tree, np.repeat(self.tree[split], 2))
        return new > 0

    def forest(self) -> IsolationForest:
        order = np.argsort(self.tree, kind="stable")
        first = np.searchsorted(self.tree[order], np.arange(self.n_trees + 1))
        own = np.empty(len(order), dtype=np.int64)
        own[order] = np.arange(len(order)) - first[self.tree[order]]
        left = np.where(self.feature >= 0, own[self.left], 0)
        parts = [order[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
        return IsolationForest([(self.feature[p], self.cut[p], left[p], self.path[p]) for p in parts], max(_mean_path(self.rows), 1e-9))


@dataclass
class IsolationForest:
    """Trees as flat arrays: feature (-1: leaf), cut, left child (right is the next), path length at leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    scale: float
    threshold: float = 1.0

    @staticmethod
    def fit(x: np.ndarray, n_trees: int = N_TREES, seed: int = 7) -> IsolationForest:
        """A forest of a few rows at hand: all go to every tree."""
        growing = Growing(n_trees, len(x), seed)
        tree, every = np.repeat(np.arange(n_trees), len(x)), np.tile(x, (n_trees, 1))
        while True:
            node = growing.place(tree, every)
            rows = np.flatnonzero(node >= growing.newest)
            rows = rows[np.argsort(node[rows], kind="stable")]
            at, first, count = np.unique(node[rows], return_index=True, return_counts=True)
            if not len(at) or not growing.split(at, count, np.minimum.reduceat(every[rows], first), np.maximum.reduceat(every[rows], first)):
                return growing.forest()

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        index = np.arange(len(x))
        for feature, cut, left, path in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[index, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, left[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.scale)

    def calibrate(self, x: np.ndarray, good: np.ndarray, max_good_loss: float) -> IsolationForest:
        """Set the threshold: of those that reject at most `max_good_loss` of
        the good rows, the one with the largest gap between bad and good rows rejected."""
        s = self.score(x)
        g, b = np.sort(s[good]), np.sort(s[~good])
        if not len(g) or not len(b):
            self.threshold = math.inf
            return self
        cuts = np.unique(s)
        lost = 1 - np.searchsorted(g, cuts, side="right") / len(g)
        caught = 1 - np.searchsorted(b, cuts, side="right") / len(b)
        gain = np.where(lost <= max_good_loss, caught - lost, -1.0)
        best = int(np.argmax(gain))
        self.threshold = float(cuts[best]) if gain[best] > 0 else math.inf
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, max_rows: int) -> DataFrame:
    """At most `max_rows` labelled documents, chosen by a hash of the key: (key, label, text).

    The bound makes the chosen labels fit a broadcast at every scale.
    """
    order = [F.xxhash64(col(key)), col(key)]
    chosen = labels.where(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias(key)).agg(F.max(col(label)).alias(label))
    chosen = chosen.orderBy(*order).limit(max_rows)
    return docs.select(col(key).alias(key), col(text).alias(text)).join(F.broadcast(chosen), key)


def _with_rates(stats: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the rates (`features`) of rows with STATS."""
    source = stats.select(*[col(c) for c in keep], *STATS)
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in _RATES)])

    def run(batches):
        for b in batches:
            x = features(np.column_stack([b.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(v) for v in x.T)], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _RATES])


def grow_forest(rows: DataFrame, key: str, n_trees: int = N_TREES, seed: int = 7) -> IsolationForest | None:
    """Forest on all rows (key, rates); None without rows.

    Each row goes to at least one tree, and to so many that a tree gets about TREE_ROWS rows.  A level
    takes one grouped aggregate over nodes; the driver sees the borders of open nodes, which are at
    most n_trees x TREE_ROWS, never rows.
    """
    n = rows.count()
    if not n:
        return None
    copies = min(n_trees, max(1, -(-n_trees * TREE_ROWS // n)))
    growing = Growing(n_trees, max(1, n * copies // n_trees), seed)
    h = F.xxhash64(col(key))
    step = 2 * F.pmod(F.shiftright(h, 20), F.lit(n_trees)) + 1  # odd, so trees of a row differ where they are a power of two
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    dealt = rows.withColumn("_copy", copy).select(F.pmod(F.pmod(h, F.lit(n_trees)) + F.col("_copy") * step, F.lit(n_trees)).cast("long").alias("_tree"), *_RATES)
    schema = T.StructType([T.StructField("_node", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in _RATES)])

    def level(now: Growing):
        def run(batches):
            for b in batches:
                x = _matrix(b)
                node = now.place(b.column(0).to_numpy(zero_copy_only=False), x)
                at = node >= now.newest
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), *(pa.array(v) for v in x[at].T)], [f.name for f in schema])

        borders = [f(c).alias(f"{name}{c}") for name, f in (("low", F.min), ("high", F.max)) for c in _RATES]
        return dealt.mapInArrow(run, schema).groupBy("_node").agg(F.count("*").alias("n"), *borders).toArrow()

    while True:
        t = level(growing)
        values = [t.column(i).to_numpy() for i in range(t.num_columns)]
        sides = np.column_stack(values[2:]) if len(t) else np.zeros((0, 10))
        if not growing.split(values[0], values[1], sides[:, :5], sides[:, 5:]):
            return growing.forest()


def calibrated(forest: IsolationForest, rows: DataFrame, max_good_loss: float) -> IsolationForest:
    """`forest` with the threshold of `IsolationForest.calibrate`, over all rows (rates, `good`).

    Scores are counted where they are made; a running sum per bucket of scores, over the totals of the
    buckets before, gives the rows below each.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(b))), b.column(b.schema.get_field_index("good"))], ["score", "good"])

    scores = rows.select("good", *_RATES).mapInArrow(run, "score double, good boolean")
    bucket = F.floor(F.col("score") * SCORE_BUCKETS).cast("int").alias("bucket")
    counts = written(scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).select(bucket, "*"), "scores")
    totals = sorted(tuple(r) for r in counts.groupBy("bucket").agg(F.sum("good"), F.sum("bad")).collect())
    goods, bads = sum(t[1] for t in totals), sum(t[2] for t in totals)
    forest.threshold = math.inf
    if not goods or not bads:
        return forest
    before = np.cumsum([(0, 0), *(t[1:] for t in totals)], axis=0).tolist()
    start = small_table(rows.sparkSession, [(t[0], *b) for t, b in zip(totals, before[:-1], strict=True)], "bucket int, good0 long, bad0 long")
    w = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    below = counts.join(F.broadcast(start), "bucket")
    lost = 1 - (F.col("good0") + F.sum("good").over(w)) / F.lit(float(goods))
    caught = 1 - (F.col("bad0") + F.sum("bad").over(w)) / F.lit(float(bads))
    gain = below.select("score", lost.alias("lost"), (caught - lost).alias("gain")).where((F.col("lost") <= max_good_loss) & (F.col("gain") > 0))
    best = gain.orderBy(F.desc("gain"), "score").limit(1).collect()
    if best:
        forest.threshold = best[0]["score"]
    return forest


def _halved(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `_fit`: true for every second one in `order`, wherever the borders between partitions fall."""
    laid = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rates")
    sizes = sorted(tuple(r) for r in laid.groupBy("_part").count().collect())
    if not sizes:
        return laid.select(*rows.columns, F.lit(True).alias("_fit"))
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    start = small_table(rows.sparkSession, [(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part int, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return written(laid.join(F.broadcast(start), "_part").select(*rows.columns, (place % 2 == 1).alias("_fit")), "halves")


def fit_forest(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_good_loss: float = 0.01) -> IsolationForest | None:
    """Forest on half of all labelled rows, threshold from the other half.

    Rows that fail the base rules are left out: the forest judges the rest.
    None if no labelled row is left.  Only counts and borders reach the driver.
    """
    return forest_of(rule_stats(docs, text, keep=[key]), labels, key, label, max_good_loss)


def forest_of(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_good_loss: float = 0.01) -> IsolationForest | None:
    """`fit_forest` of rows that have their STATS already."""
    known = labels.where(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias(key)).agg(F.max(col(label)).alias("_label"))
    judged = stats.where(f"not ({_FAILED})").join(known, key).select(col(key).alias("_key"), (F.col("_label") == 1).alias("good"), *STATS)
    rows = _halved(_with_rates(judged, ["_key", "good"]), ["_key", "good", *_RATES])
    forest = grow_forest(rows.where("_fit"), "_key")
    return forest and calibrated(forest, rows.where("not _fit"), max_good_loss)


def judge(df: DataFrame, forest: IsolationForest | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add STATS, base_failed, anomaly (forest score) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated
    three-word windows.  kept: neither failed nor more anomalous than the
    threshold.  Without a forest the anomaly is 0 and only the base rules hold.
    Null and empty texts have no words and fail; repeated rows get one verdict.
    """
    return judge_stats(rule_stats(df, text, keep), forest)


def judge_stats(scored: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """`judge` of rows that have their STATS already."""
    names = [c for c in scored.columns if c not in ("anomaly", "base_failed", "kept")]
    scored = scored.select(*[col(c) for c in names])
    schema = T.StructType([*scored.schema.fields, T.StructField("anomaly", T.DoubleType())])
    at = [names.index(s) for s in STATS]

    def run(batches):
        for b in batches:
            x = features(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in at])) if b.num_rows else np.zeros((0, 5))
            s = forest.score(x) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [f.name for f in schema])

    limit = forest.threshold if forest else math.inf
    judged = scored.mapInArrow(run, schema)
    return judged.withColumn("base_failed", F.expr(_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))


def op8_quality_rules(spark, sf_dir):
    """Rule statistics and verdict for every document."""
    stats = written(rule_stats(read(spark, sf_dir, "documents"), keep=["doc_id"]), "rule_stats")
    forest = forest_of(stats, read(spark, sf_dir, "labels"))
    return judge_stats(stats, forest).select("doc_id", *STATS[:5], "base_failed", "kept", "anomaly")
