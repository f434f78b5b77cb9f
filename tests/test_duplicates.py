"""Duplicates that are decided in the task that scores them, and merges that carry a prototype once."""

import random

import numpy as np
import pytest
from tracewell.operators import identity as V

NOW = 200_000_000
SCHEMA = "gid long, prototype array<double>, camera_id string, last_us long, assigned boolean, colour array<double>, attributes array<double>, hits long"


def unit(v):
    return [float(x) for x in v / np.linalg.norm(v)]


def tables(seed=4):
    """Identities with 0 to 4 anchors that lack looks, prototypes, anchors or themselves in the gallery."""
    rng, r = random.Random(seed), np.random.default_rng(seed)
    anchors = [(g * 3, unit(0.6 + r.normal(size=6))) for g in range(40) for _ in range(g % 5)] + [(6, None)]
    gallery = [
        (
            g * 3,
            rng.choice([None, unit(0.6 + r.normal(size=6)), unit(0.6 + r.normal(size=6))]),
            rng.choice(["a", "b", None]),
            rng.choice([None, NOW, NOW - 5_000_000, NOW - 50_000_000, NOW - 60_000_000, NOW - 70_000_000]),
            rng.choice([True, False, False, None]),
            rng.choice([None, [0.5], unit(np.abs(r.normal(size=3))), unit(np.abs(r.normal(size=3)))]),
            rng.choice([None, [0.0, 0.0], unit(np.abs(r.normal(size=2)))]),
            g,
        )
        for g in range(2, 42)
    ]
    return anchors, gallery


def plain(anchors, gallery, threshold):
    best = lambda x: np.sort(x)[-3:].mean()
    own = {}
    for g, e in anchors:
        if e is not None:
            own.setdefault(g, []).append(np.array(e))
    part = lambda x, y, size: 0.5 if x is None or y is None or len(x) != len(y) or not size(x) * size(y) else np.dot(x, y) / size(x) / size(y)
    out = {}
    for a in gallery:
        for b in gallery:
            pool = own.get(b[0], []) + ([np.array(b[1])] if b[1] else [])
            if a[0] >= b[0] or a[0] not in own or not pool:
                continue
            # what is unknown speaks against a merge, unless the other one settles it
            if not (a[4] is False or b[4] is False) or not any(x[3] is not None and x[3] <= NOW - 12_000_000 for x in (a, b)):
                continue
            s = best([best([x @ y for y in pool]) for x in own[a[0]]])
            w = (0.80, 0.15, 0.05) if a[2] is not None and a[2] == b[2] else (0.70, 0.25, 0.05)
            score = w[0] * s + w[1] * min(1.0, max(0.0, part(a[5], b[5], lambda x: 1.0))) + w[2] * part(a[6], b[6], np.linalg.norm)
            if score >= threshold:
                out[a[0], b[0]] = score
    return out


@pytest.mark.parametrize("rows", [5, 30, 1000])
def test_duplicates_of_all_blocks(spark, monkeypatch, rows):
    def shuffled(*args, **kwargs):
        raise AssertionError("a table of all scores")

    monkeypatch.setattr(V, "identity_scores", shuffled)
    anchors, gallery = tables()
    a, g = spark.createDataFrame(anchors, "gid long, embedding array<double>"), spark.createDataFrame(gallery, SCHEMA)
    got = {(r.a, r.b): r.score for r in V.duplicate_pairs(a, g, NOW, block_rows=rows).collect()}
    want = plain(anchors, gallery, 0.48)
    assert len(want) > 20 and got == pytest.approx(want)
    assert V.duplicate_pairs(a.where("false"), g, NOW).count() == 0


def test_merges_read_each_prototype_once(spark, monkeypatch):
    """A clique of 30 identities has 435 pairs; 30 prototypes go to its fold."""
    read = []
    real = V.grouped_fold

    def fold(df, *args):
        read.append(df.where("prototype is not null").count() if "prototype" in df.columns else df.count())
        return real(df, *args)

    monkeypatch.setattr(V, "grouped_fold", fold)
    g = spark.createDataFrame([(i, i % 7, [1.0, float(i)]) for i in range(31)], "gid long, hits long, prototype array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(30) for j in range(i + 1, 30)] + [(3, 99)], "a long, b long")
    got = {r.gid: r.kept for r in V.merge_identities(pairs, g).collect()}
    assert read == [30]
    assert set(got) == set(range(30)) and [x for x, k in got.items() if x == k] == sorted(set(got.values()))
