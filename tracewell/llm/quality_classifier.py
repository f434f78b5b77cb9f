"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word (hashed to a bucket) owns a sparse random index vector.  A word's
vector is the sum of the index vectors of its neighbours, over all documents:
integer sums, so the result doesn't depend on the partitioning.  A document is
the mean of its words' unit vectors.  A small numpy network on a bounded
labelled sample gives logits, and a temperature fitted on rows kept aside
turns them into calibrated probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm.frames import col, map_text, read
from tracewell.llm.quality_rules import labelled_sample

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 48, 3, 2
_STEP = 1 << 17


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    c = K.chunk(texts)
    starts, ends, before = c.words(K.SPACED)
    return K.spans_hash(c.bytes_prefix(), starts, ends), before


def _bucket(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(50)).astype(np.int64)


def neighbour_sums(word: np.ndarray, before: np.ndarray, total: np.ndarray) -> None:
    """Add to total (BUCKETS x DIMS, flat) each word's neighbours' index vectors."""
    n = len(word)
    if not n:
        return
    at = _bucket(word) * DIMS
    of = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for k in range(NONZERO):
        bits = K.mix(word + np.uint64(k + 1))
        dim = (bits % np.uint64(DIMS)).astype(np.int64)
        sign = np.where(bits >> np.uint64(63), 1, -1).astype(np.float64)
        for d in range(1, REACH + 1):
            near = of[d:] == of[:-d]
            for center, other in ((at[:-d], slice(d, None)), (at[d:], slice(None, -d))):
                total += np.bincount((center + dim[other])[near], sign[other][near], minlength=len(total)).astype(np.int64)


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIMS unit vectors (float32) from the words of all rows.

    A task adds up its own rows; the partial sums of a bucket are added by a
    grouped sum.  What reaches the driver is the one matrix, of fixed size.
    """
    names = [f"d{i}" for i in range(DIMS)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in names)])

    def run(batches):
        total = np.zeros(BUCKETS * DIMS, dtype=np.int64)
        for b in batches:
            for first, n in K.slices(b.column(0)):
                neighbour_sums(*_words(b.column(0).slice(first, n)), total)
        m = total.reshape(BUCKETS, DIMS)
        used = np.flatnonzero(m.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(m[used, i]) for i in range(DIMS))], schema.names)

    sums = df.select(col(text)).mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names])
    out = np.zeros((BUCKETS, DIMS))
    for r in sums.toLocalIterator():
        out[r[0]] = r[1:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text, its length, the share of words equal to
    the one before, and the logarithm of the word count."""
    word, before = _words(texts)
    sums = np.zeros((len(texts), DIMS))
    at = _bucket(word)
    of = np.repeat(np.arange(len(texts)), np.diff(before))
    for i in range(0, len(at), _STEP):
        part = of[i : i + _STEP]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sums[part[first]] += np.add.reduceat(vectors[at[i : i + _STEP]], first, axis=0)
    n = np.diff(before)
    mean = sums / np.maximum(n, 1)[:, None]
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    return np.column_stack([mean, np.linalg.norm(mean, axis=1), K.per_text(same, before) / np.maximum(n, 1), np.log1p(n)])


def document_vectors(df: DataFrame, vectors: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `vector` (array of double): the pooled features of each text.

    Null and empty texts pool no words and get zeros.
    """
    sent = df.sparkSession.sparkContext.broadcast(vectors)

    def setup():
        def work(texts: pa.Array) -> list[pa.Array]:
            x = pooled(texts, sent.value)
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))]

        return work

    return map_text(df, text, setup, [T.StructField("vector", T.ArrayType(T.DoubleType()))], keep)


@dataclass
class Network:
    """Two layers: tanh, then one logit over a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - mean) / spread
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), batch):
                part = order[i : i + batch]
                h = np.tanh(z[part] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(err, p[2]) * (1 - h * h)
                grads = [z[part].T @ back + decay * p[0], back.sum(axis=0), h.T @ err + decay * p[2], np.array([err.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return Network(mean, spread, p[0], p[1], p[2], float(p[3][0]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """The temperature (of a grid) with the least loss on rows kept aside."""
        if len(y):
            s = np.where(y > 0.5, 1, -1) * self.logit(x)
            grid = np.geomspace(0.25, 8, 61)
            self.temperature = float(grid[int(np.argmin([np.logaddexp(0, -s / t).mean() for t in grid]))])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network | None


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, max_fit_rows: int = 20_000) -> QualityModel:
    """Word vectors over all rows; the network on labelled rows for which `learn` holds.

    `learn` is a condition on the labels table.  At most `max_fit_rows` labelled
    keys, chosen by hash, are used; a fifth of them sets the temperature.  With
    one class only, or no labels, there is no network and every score is 0.5.
    """
    vectors = word_vectors(docs, text)
    known = labels.where(learn) if learn is not None else labels
    sample = document_vectors(labelled_sample(docs, known, label, key, text, max_fit_rows), vectors, text, keep=[key, label])
    rows = sample.orderBy(F.xxhash64(col(key)), F.xxhash64("vector")).limit(max_fit_rows).collect()
    x = np.array([r["vector"] for r in rows])
    y = np.array([r[label] for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, None)
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    return QualityModel(vectors, Network.fit(x[~aside], y[~aside]).calibrate(x[aside], y[aside]))


def score(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `score` (probability of label 1) and `predicted` (1 if 0.5 or more)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def setup():
        m = sent.value

        def work(texts: pa.Array) -> list[pa.Array]:
            p = m.network.probability(pooled(texts, m.vectors)) if m.network else np.full(len(texts), 0.5)
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

        return work

    return map_text(df, text, setup, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op3_quality_classifier(spark, sf_dir):
    """Score of every document; labels of held-out rows are not learned."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), learn=~held_out(F.col("doc_id")))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
