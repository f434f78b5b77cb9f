"""What a row of the online gallery costs: one product for all its questions, and few identities scored one by one."""

from dataclasses import replace

import numpy as np
import pytest
from tracewell.streaming import gallery as G

RULES = G.labelled(G.Rules(window=5), ("gender", "upred", "upblue"))


def crowd(n, seed=3):
    r = np.random.default_rng(seed)
    unit = lambda: G.unit(r.normal(size=32))
    return {g: G.Entry(f"c{g % 3}", 1_000_000 * (g % 50), 1, unit(), [unit() for _ in range(1 + g % 4)], [1.0] * (1 + g % 4), *((r.random(3), r.random(4)) if g % 5 else (None, None))) for g in range(1, n)}, unit


def test_a_row_scores_few_identities(monkeypatch):
    entries, unit = crowd(600)
    g = G.Gallery(replace(RULES, threshold=0.9), entries, {}, {}, 1000)  # no row decides before the last one
    asked, pooled = [], []
    real = G.vetoed
    monkeypatch.setattr(G, "vetoed", lambda *a: asked.append(1) or real(*a))
    whole = G.Pools.like
    monkeypatch.setattr(G.Pools, "like", lambda *a: pooled.append(1) or whole(*a))
    r = np.random.default_rng(5)
    for i in range(5):  # the last row fills the window
        told = g.see("c1", 7, 60_000_000 + i, unit(), 1.0, r.random(3), r.random(4))
    # 18 questions of 599 identities; those of the last 90 s and of the camera are asked at the end
    assert told is not None and told[1] in ("new", "closed", "rescue")
    assert not pooled and len(asked) < 600


def test_possible_ones_are_all_that_can_win():
    entries, unit = crowd(200)
    p = G.Pools(entries)
    r = np.random.default_rng(9)
    for _ in range(60):
        e = entries[int(r.integers(1, 200))]
        v = [G.unit(e.anchors[0] + r.normal(size=32) * 0.15), unit()]
        a, colour = [r.random(3), None], r.random(4) if r.random() < 0.7 else None
        now, camera = 100_000_000, "c1"
        for x, worn, got in zip(v, a, p.possible(RULES, v, a, colour, camera, now), strict=True):
            want = {}
            for gid, e in entries.items():
                s = np.sort(e.pool() @ x)[-3:].mean()
                s = min(1.0, s + RULES.bonus) if now - e.last_us <= 90e6 else s
                shade = 0.5 if colour is None or e.colour is None else min(1.0, max(0.0, colour @ e.colour))
                w = (0.80, 0.15, 0.05) if e.camera_id == camera else (0.70, 0.25, 0.05)
                score = w[0] * s + w[1] * shade + w[2] * G._alike(worn, e.attributes)
                if score >= RULES.threshold:
                    want[gid] = score
            told = {gid: score for score, gid, _ in got}
            assert {g: told.get(g) for g in want} == pytest.approx(want)
            assert [x[0] for x in got] == sorted((x[0] for x in got), reverse=True)


def test_only_what_is_old_is_forgotten():
    entries, unit = crowd(30)
    entries[5].last_us = 8_000_000_000
    g = G.Gallery(RULES, dict(entries), {("c1", 1): (5, 8_000_000_000)}, {}, 100)
    assert g.next_due() == min(1_000_000 * (i % 50) for i in entries if i != 5) + 7_200_000_000
    g.forget(7_200_000_000 + 20_500_000)
    assert set(g.entries) == {i for i in entries if i > 20 or i == 5} == set(g.pools.slots)
