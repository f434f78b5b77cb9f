"""Vector codes and hard negatives against plain Python, and on edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tracewell.llm import hard_negatives, vector_codes
from tracewell.llm.vectors import scaled

VEC = "vec_id long, embedding array<double>, label int"


def vectors(n: int, size: int = 8, seed: int = 1) -> list:
    """Few distinct values: many ties in sums, distances and scores."""
    rng = random.Random(seed)
    return [(i, [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5]) for _ in range(size)], rng.randrange(3)) for i in range(n)]


BAD = [
    (3000, None, 1),
    (3001, [1.0, None] + [0.0] * 6, 1),
    (3002, [math.nan] + [0.0] * 7, 1),
    (3003, [math.inf] * 8, 1),
    (3004, [], 1),
]


def brute_codes(rows: list, parts: int, entries: int, rounds: int, scale: int = 4096):
    whole = [(k, [math.floor(scale * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(whole[0][1]) // parts
    first = {}
    for k, v, _ in whole:
        k = math.inf if k is None else k
        first[k] = min(v, first.get(k, v))
    seeds = [first[k] for k in sorted(first)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in seeds] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), i) for i, y in enumerate(books[p]))

    for _ in range(rounds):
        own = [[[] for _ in seeds] for _ in range(parts)]
        for _, v, _ in whole:
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                own[p][nearest(p, x)[1]].append(x)
        books = [[[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else books[p][i] for i, xs in enumerate(own[p])] for p in range(parts)]
    out = []
    for k, v, label in whole:
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return books, sorted(((k, c, e, sums[label]) for k, c, e, label in out), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_codes_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(vector_codes, "SMALL_ROWS", 1)
    extra = [(None, [0.5] * 8, None), (5, [0.125] * 8, None), (5, [-0.5] * 8, 2), (7, vectors(8)[7][1], vectors(8)[7][2])]
    rows = vectors(300) + BAD + extra
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit("clash") for c in ("code", "error", "label_error", "k", "v", "_label", "slot")}).repartition(5)
    for entries in (16, 500):
        books = vector_codes.fit(df, parts=4, entries=entries)
        want, coded = brute_codes(rows, 4, entries, vector_codes.ROUNDS)
        assert books.entries.tolist() == want
        out = vector_codes.with_group_error(vector_codes.encode(df, books, keep=["vec_id", "label"]))
        assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=str) == [(k, c[: 2 * 4], e, s) for k, c, e, s in coded] or entries > 256


def test_equal_average_search_finds_the_nearest():
    rng = np.random.default_rng(3)
    for size in (1, 2, 16):
        entries = rng.integers(-9, 9, size=(2, size, 3))
        x = rng.integers(-12, 12, size=(500, 6))
        index, away = vector_codes.Codebooks(entries, 1).nearest(x)
        for p in range(2):
            d = ((x[:, None, 3 * p : 3 * p + 3] - entries[p]) ** 2).sum(axis=2)
            assert (index[:, p] == d.argmin(axis=1)).all() and (away[:, p] == d.min(axis=1)).all()


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], VEC)
    for df in (none, spark.createDataFrame(BAD, VEC)):
        assert vector_codes.fit(df) is None
        assert vector_codes.with_group_error(vector_codes.encode(df, None, keep=["vec_id", "label"])).count() == 0
    books = vector_codes.fit(spark.createDataFrame(vectors(20), VEC))
    assert vector_codes.encode(none, books).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(spark.createDataFrame(vectors(20, size=6), VEC))


def test_scaled():
    column = pa.array([[0.1], [-0.1], None, [None], [math.nan], []], pa.list_(pa.float64()))
    kept, x = scaled(column.slice(1), 256)
    assert kept.tolist() == [0] and x.tolist() == [[-26]]
    with pytest.raises(ValueError, match="components"):
        scaled(pa.array([[1.0], [1.0, 2.0]]), 256)
    with pytest.raises(ValueError, match="or more"):
        scaled(pa.array([[1e300]]), 256)


# ---- hard negatives ----------------------------------------------------------------


def brute_negatives(rows: list, is_anchor, k: int = 5, n: int = 3) -> list:
    by = {}
    for key, v, label in rows:
        if key is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * c) for c in v]
            by[key] = min((label, x), by.get(key, (label, x)), key=lambda m: (m[0], np.array(m[1], np.int32).tobytes()))
    out = []
    for a in by:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(by[a][1], by[b][1], strict=True)), b) for b in by if b != a)
        for s, p in [(-s, b) for s, b in scored if by[b][0] == by[a][0]][:k]:
            hard = [(-t, b) for t, b in scored if by[b][0] != by[a][0] and 50 * s <= -100 * t <= 95 * s]
            out += [(a, p, r + 1, b, s, t) for r, (t, b) in enumerate(hard[:n])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "block_anchors": 7}])
def test_negatives_equal_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", 4)
    rng = random.Random(9)
    near = [(i, [rng.gauss(0, 0.2) + (0.3 if j == i % 3 else 0) for j in range(8)], i % 3) for i in range(500, 900)]
    rows = vectors(400) + near + BAD + [(None, [0.5] * 8, 1), (10, [0.5] * 8, None), (20, [0.0] * 8, 1), (20, [0.25] * 8, 1), (20, [0.25] * 8, 1), (30, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit("clash") for c in ("key", "v", "shard", "block", "rank", "anchor_id")}).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda a: a % 10 == 0)


def test_lists_stop_early_and_stay_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-30, 30, size=(4000, 2))
    lists = hard_negatives.Lists(np.arange(4000), np.zeros(4000, dtype=np.int64), x)
    asked = []
    inner = lists.scores
    lists.scores = lambda rows, anchor: asked.append(len(rows)) or inner(rows, anchor)
    for anchor in (np.array([3, -2]), np.array([0, 5]), np.array([0, 0])):
        s = x @ anchor
        order = np.lexsort((np.arange(4000), -s))
        (at, found), (at2, _) = lists.best(anchor, 7, [(-(10**9), 10**9), (-(10**9), 50 * int(s[order[0]]))], None)
        assert at.tolist() == order[:7].tolist() and found.tolist() == s[order[:7]].tolist()
        assert at2.tolist() == [i for i in order if 100 * s[i] <= 50 * int(s[order[0]])][:7]
    asked.clear()
    lists.best(np.array([3, -2]), 3, None, None)
    assert sum(asked) < 2000


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VEC)
    assert hard_negatives.mine(none, F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(vectors(30), VEC), F.col("vec_id") < 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(BAD, VEC), F.col("vec_id") >= 0).count() == 0
