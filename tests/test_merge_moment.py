"""Merges take in every pair of identities at rest, whenever they were last seen."""

import numpy as np
from tracewell.plans import identity as P
from tracewell.plans.registry import QUERIES
from tracewell.sources import adapters as X

SF = "/root/testdata/sf0.001"


def unit(v):
    return v / np.linalg.norm(v)


def mean_of_best(x, k=3):
    return np.sort(x, axis=-1)[..., -k:].mean(axis=-1)


def plain_pairs(vectors, g, now):
    """Every pair of identities by its fused score and its veto, in order."""
    out = []
    for a in g:
        for b in g:
            if a >= b or (g[a]["assigned"] and g[b]["assigned"]) or min(g[a]["last_us"], g[b]["last_us"]) > now - 12_000_000:
                continue
            s = mean_of_best(mean_of_best(np.stack(vectors[a]) @ np.stack([*vectors[b], g[b]["prototype"]]).T))
            x, y = np.array(g[a]["colour"]), np.array(g[b]["colour"])
            w = (0.80, 0.15) if g[a]["camera_id"] == g[b]["camera_id"] else (0.70, 0.25)
            veto = x.max() >= 0.25 and y.max() >= 0.25 and unit(x) @ unit(y) < 0.6
            if w[0] * s + w[1] * min(1.0, max(0.0, x @ y)) + 0.025 >= 0.48 and not veto:
                out.append((a, b))
    return out


def test_merges_of_the_whole_gallery(spark):
    g = {r["gid"]: r.asDict() for r in P.gallery(spark, SF).collect()}
    vectors = {}
    for r in X.vectors(spark, SF).collect():
        vectors.setdefault(r["gid"], []).append(np.array(r["embedding"]))
    pairs = plain_pairs(vectors, g, max(r["last_us"] for r in g.values()))
    gone = {}
    for a, b in pairs:
        keep, drop = (a, b) if g[a]["hits"] >= g[b]["hits"] else (b, a)
        if keep not in gone and drop not in gone:
            gone[drop] = keep

    def root(x):
        while x in gone:
            x = gone[x]
        return x

    got = {r["gid"]: r["kept"] for r in QUERIES["v15_merge_identities"](spark, SF).collect() if r["gid"] != r["kept"]}
    assert got == {x: root(x) for x in gone}
    # identities first seen after the first 100 s take part
    assert sum(min(x, root(x)) > 20 for x in gone) > 3
    hits = {r["gid"]: r["hits"] for r in QUERIES["v15_merged_gallery"](spark, SF).collect()}
    assert hits == {x: sum(g[o]["hits"] for o in g if root(o) == x) for x in g if x not in gone}
