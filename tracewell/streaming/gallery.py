"""Identity assignment as a stream: every match changes the gallery that the next track meets.

One state per store.  It holds the store's identities (a map by id), its live
tracks (a map by camera and track), and the vectors of tracks that wait for a
decision (a list).  Decisions of a store depend on each other, so a store is
the unit of work; stores are independent and spread over the cluster.  An event
time timer per store drops what expired, so the state of a quiet store goes too;
expiry follows event time, not the processing time of state TTL, so that a replay
gives the same ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from tracewell.streaming.jobs import LATE

ENTRY = "camera_id string, last_us long, hits long, prototype array<double>, anchors array<array<double>>, qualities array<double>, attributes array<double>, colour array<double>"
WAITING = "camera_id string, track_id long, ts_us long, embedding array<double>, sharpness double, attributes array<double>"
DECIDED = "store string, camera_id string, track_id long, ts_us long, gid long, how string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the decisions; labels names the attribute probabilities, which the veto reads."""

    threshold: float = 0.42
    cross_camera: float = 0.02
    margin: float = 0.03
    bonus: float = 0.12
    recent_s: float = 90.0
    window: int = 7
    best_of: int = 3
    guard_s: float = 15.0
    rescue: float = 0.36
    closed_from_s: float = 5.0
    closed_to_s: float = 120.0
    closed_alone: float = 0.15
    closed_several: float = 0.25
    drift: float = 0.32
    novelty: float = 0.72
    max_anchors: int = 48
    best_anchors: int = 8
    sharp_colour: float = 8.0
    expiry_s: float = 7200.0
    track_s: float = 60.0
    labels: tuple[str, ...] = ()
    gender_gap: float = 0.60
    strong: float = 0.45
    least_alike: float = 0.35
    parts: tuple[tuple[int, ...], ...] = field(default=(), init=False)

    def __post_init__(self):
        parts = (tuple(i for i, x in enumerate(self.labels) if x.startswith(p) and x != p) for p in ("up", "down"))
        object.__setattr__(self, "parts", tuple(p for p in parts if p))


@dataclass
class Entry:
    camera_id: str
    last_us: int
    hits: int
    prototype: np.ndarray
    anchors: list[np.ndarray]
    qualities: list[float]
    attributes: np.ndarray | None
    colour: np.ndarray | None
    meant: bool = False  # whether the prototype is the mean of these anchors

    def pool(self) -> np.ndarray:
        return np.vstack([self.prototype, *self.anchors])

    def take(self, rules: Rules, ts_us: int, v: np.ndarray, sharpness: float, attributes: np.ndarray | None, colour: np.ndarray | None, near: float) -> bool:
        """Enrich the identity by a vector of its own, whose best similarity with its anchors is `near`; whether its pool changed."""
        new = not self.meant
        if near < rules.novelty:
            if len(self.anchors) < rules.max_anchors:
                self.anchors.append(v)
                self.qualities.append(sharpness)
                new = True
            else:
                worst = int(np.argmin(self.qualities))
                if sharpness > self.qualities[worst]:
                    self.anchors[worst], self.qualities[worst] = v, sharpness
                    new = True
        if new:
            order = np.argsort(-np.array(self.qualities), kind="stable")[: rules.best_anchors]
            self.prototype, self.meant = unit(np.mean([self.anchors[i] for i in order], axis=0)), True
        if attributes is not None:
            self.attributes = attributes if self.attributes is None else 0.95 * self.attributes + 0.05 * attributes
        if colour is not None and sharpness > rules.sharp_colour:
            self.colour = colour if self.colour is None else unit(0.80 * self.colour + 0.20 * colour)
        self.last_us, self.hits = ts_us, self.hits + 1
        return new


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n > 1e-8 else v


def vetoed(rules: Rules, a: np.ndarray | None, b: np.ndarray | None) -> bool:
    """Whether attribute probabilities speak against one person: genders far apart, or clearly different colours."""
    if a is None or b is None:
        return False
    if "gender" in rules.labels:
        g = rules.labels.index("gender")
        if abs(a[g] - b[g]) > rules.gender_gap:
            return True
    for part in rules.parts:
        if max(a[i] for i in part) < rules.strong or max(b[i] for i in part) < rules.strong:
            continue
        x, y = a[list(part)], b[list(part)]
        size = float(np.linalg.norm(x) * np.linalg.norm(y))
        if min(x.max(), y.max()) >= rules.strong and size > 1e-12 and float(x @ y) / size < rules.least_alike:
            return True
    return False


def _alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return 0.5
    n = math.sqrt(a @ a), math.sqrt(b @ b)
    return float(a @ b / (n[0] * n[1])) if min(n) >= 1e-6 else 0.5


def best_means(s: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k largest finite values of each row."""
    if s.shape[1] > k:
        s = np.partition(s, s.shape[1] - k, axis=1)[:, -k:]
    s = np.sort(s, axis=1)
    some = np.isfinite(s)
    return np.where(some, s, 0.0).sum(axis=1) / np.maximum(some.sum(axis=1), 1)


class Pools:
    """Prototypes and anchors of all identities in one matrix, kept up identity by identity."""

    def __init__(self, entries: dict[int, Entry]):
        self.slots: dict[int, int] = {}
        self.gids = np.zeros(0, dtype=np.int64)
        self.rows: np.ndarray | None = None  # row 0 stands for no vector
        self.rough: np.ndarray | None = None  # the rows in single precision
        self.of = np.full(1, -1)  # slot of each row, -1: none
        self.at = np.zeros((0, 1), dtype=np.int64)  # rows of each slot
        self.n = np.zeros(0, dtype=np.int64)  # how many
        self.longest = 1.0  # no row was longer
        self.free_rows: list[int] = []
        self.free_slots: list[int] = []
        # of each slot: what it wears (attributes of length 1; 0: none), and what is added to its products (0.5: none)
        self.worn: dict[str, np.ndarray | None] = {"attributes": None, "colour": None}
        self.bare = {name: np.zeros(0) for name in self.worn}
        self.seen, self.cameras = np.zeros(0), np.zeros(0, dtype=np.int64)
        self.numbers: dict[str, int] = {}  # of cameras
        for gid, e in entries.items():
            self.put(gid, e)

    def put(self, gid: int, e: Entry) -> None:
        pool = e.pool()
        if self.rows is None:
            self.rows = np.zeros((1, pool.shape[1]))
            self.rough = self.rows.astype(np.float32)
        if gid not in self.slots:
            if not self.free_slots:
                n = max(16, len(self.gids))
                self.free_slots = list(range(len(self.gids) + n - 1, len(self.gids) - 1, -1))
                more = lambda x, value: np.concatenate([x, np.full((n, *x.shape[1:]), value, dtype=x.dtype)])
                self.gids, self.at, self.n = more(self.gids, -1), more(self.at, 0), more(self.n, 0)
                self.seen, self.cameras = more(self.seen, 0.0), more(self.cameras, -1)
                self.worn = {name: None if x is None else more(x, 0.0) for name, x in self.worn.items()}
                self.bare = {name: more(x, 0.5) for name, x in self.bare.items()}
            self.slots[gid] = self.free_slots.pop()
            self.gids[self.slots[gid]] = gid
        slot = self.slots[gid]
        if self.at.shape[1] < len(pool):
            self.at = np.pad(self.at, ((0, 0), (0, len(pool) - self.at.shape[1])))
        own = [int(r) for r in self.at[slot, : self.n[slot]]]
        while len(own) < len(pool):
            if not self.free_rows:
                n = max(64, len(self.rows) // 4)
                self.free_rows = list(range(len(self.rows) + n - 1, len(self.rows) - 1, -1))
                self.rows = np.concatenate([self.rows, np.zeros((n, self.rows.shape[1]))])
                self.rough = np.concatenate([self.rough, np.zeros((n, self.rows.shape[1]), dtype=np.float32)])
                self.of = np.concatenate([self.of, np.full(n, -1)])
            own.append(self.free_rows.pop())
        self.free_rows += own[len(pool) :]
        self.of[own] = -1
        own = own[: len(pool)]
        self.rows[own] = self.rough[own] = pool
        self.of[own] = slot
        self.at[slot] = 0
        self.at[slot, : len(own)] = own
        self.n[slot] = len(own)
        self.longest = max(self.longest, float(np.sqrt((pool * pool).sum(axis=1).max())))
        self.cameras[slot] = self.numbers.setdefault(e.camera_id, len(self.numbers))
        self.touch(gid, e)

    def touch(self, gid: int, e: Entry) -> None:
        """Keep up all but the vectors."""
        slot = self.slots[gid]
        self.seen[slot] = e.last_us
        for name, x in (("attributes", e.attributes), ("colour", e.colour)):
            if name == "attributes" and x is not None:
                n = math.sqrt(x @ x)
                x = x / n if n >= 1e-6 else None
            if self.worn[name] is None and x is not None:
                self.worn[name] = np.zeros((len(self.gids), len(x)))
            if self.worn[name] is not None:
                self.worn[name][slot] = 0.0 if x is None else x
            self.bare[name][slot] = 0.5 if x is None else 0.0

    def by_look(self, name: str, asked: Sequence[np.ndarray | None]) -> np.ndarray:
        """Products of each of `asked` with what the identity of each slot wears (of attributes the cosines), 0.5 where a side has none."""
        out = np.full((len(asked), len(self.gids)), 0.5)
        for i, x in enumerate(asked):
            n = 0.0 if x is None else math.sqrt(x @ x) if name == "attributes" else 1.0
            if n >= 1e-6 and self.worn[name] is not None:
                out[i] = self.worn[name] @ (x / n) + self.bare[name]
        return out

    def possible(self, rules: Rules, vectors: Sequence[np.ndarray], attributes: Sequence[np.ndarray | None], colour: np.ndarray | None, camera: str, now: int) -> list[list[tuple[float, int, float]]]:
        """For each vector with its attributes: identities whose score may reach what a match or its runner-up needs.

        As (score, gid, similarity), best first; scores are those of `Gallery._best` but for rounding.  One product in
        single precision, with room for its rounding, leaves few identities to be scored.
        """
        if not self.slots:
            return [[] for _ in vectors]
        r, v, slots = rules, np.stack(vectors), len(self.gids)
        enough = r.threshold + min(0.0, r.cross_camera) - 1e-6
        here = self.cameras == self.numbers.get(camera, -2)
        weight = np.where(here, 0.80, 0.70)
        lift = np.where(now - self.seen <= r.recent_s * 1e6, r.bonus, 0.0)
        rest = np.where(here, 0.15, 0.25) * np.minimum(1.0, np.maximum(0.0, self.by_look("colour", [colour])[0])) + 0.05 * self.by_look("attributes", attributes)
        room = 1e-4 * max(1.0, self.longest * float(np.sqrt((v * v).sum(axis=1).max())))
        need = ((enough - rest) / weight - lift - room).astype(np.float32)
        need[:, self.gids < 0] = np.inf
        s = self.rough @ v.astype(np.float32).T
        # the mean of the best similarities is never above the best one
        row, ask = np.divmod(np.flatnonzero(~(s < need.min(axis=1))), len(v))
        slot = self.of[row]
        keep = np.flatnonzero((slot >= 0) & ~(s[row, ask] < need[ask, slot]))
        out: list[list[tuple[float, int, float]]] = [[] for _ in vectors]
        if not len(keep):
            return out
        ask, slot = np.divmod(np.unique(ask[keep] * slots + slot[keep]), slots)
        at = self.at[slot, : self.n[slot].max()]
        none = at == 0
        near = s[at, ask[:, None]]
        near[none] = -np.inf
        keep = ~(best_means(near, 3) < need[ask, slot])
        ask, slot, at, none = ask[keep], slot[keep], at[keep], none[keep]
        if not len(ask):
            return out
        near = np.matmul(self.rows[at], v[ask][:, :, None])[:, :, 0]
        near[none] = -np.inf
        means = best_means(near, 3)
        score = weight[slot] * np.where(lift[slot] > 0, np.minimum(1.0, means + r.bonus), means) + rest[ask, slot]
        keep = np.flatnonzero(~(score < enough))
        gids = self.gids[slot]
        for i in keep[np.lexsort((gids[keep], -score[keep]))]:
            out[ask[i]].append((float(score[i]), int(gids[i]), float(means[i])))
        return out

    def like_of(self, gids: Sequence[int], v: np.ndarray) -> dict[int, float]:
        """Mean of the three best similarities with each of these."""
        if not len(gids):
            return {}
        slot = np.array([self.slots[g] for g in gids])
        at = self.at[slot, : self.n[slot].max()]
        s = self.rows[at] @ v
        s[at == 0] = -np.inf
        return dict(zip(gids, best_means(s, 3).tolist(), strict=True))

    def own(self, gid: int, v: np.ndarray) -> np.ndarray:
        """Similarities with an identity's prototype and anchors."""
        slot = self.slots[gid]
        return self.rows[self.at[slot, : self.n[slot]]] @ v

    def drop(self, gid: int) -> None:
        slot = self.slots.pop(gid)
        own = [int(r) for r in self.at[slot, : self.n[slot]]]
        self.free_rows += own
        self.of[own] = -1
        self.at[slot], self.n[slot], self.gids[slot] = 0, 0, -1
        self.free_slots.append(slot)

    def like(self, v: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(gids, mean of the k best similarities with each)."""
        if not self.slots:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        s = self.rows @ v
        s[0] = -np.inf
        held = np.flatnonzero(self.gids >= 0)
        return self.gids[held], best_means(s[self.at[held]], k)


class Gallery:
    """The identities of one store while a batch of its rows is looked at."""

    def __init__(self, rules: Rules, entries: dict[int, Entry], tracks: dict[tuple[str, int], tuple[int, int]], waiting: dict[tuple[str, int], list[tuple]], next_gid: int):
        self.rules, self.entries, self.tracks, self.waiting, self.next_gid = rules, entries, tracks, waiting, next_gid
        self.changed: set[int] = set()
        self.pools = Pools(entries)
        self._on: dict[tuple[str, int], set[int]] = {}  # tracks of a camera that hold an identity
        for (camera, track), (gid, _) in tracks.items():
            self._on.setdefault((camera, gid), set()).add(track)
        self._due = self.next_due()  # nothing expires before

    def forget(self, now_us: int) -> None:
        """Drop identities and tracks that were unseen for too long."""
        r = self.rules
        if self._due is None or now_us <= self._due:
            return
        p = self.pools
        for gid in p.gids[(p.gids >= 0) & (now_us - p.seen > r.expiry_s * 1e6)].tolist():
            del self.entries[gid]
            self.changed.add(gid)
            self.pools.drop(gid)
        for key in [k for k, (_, seen) in self.tracks.items() if now_us - seen > r.track_s * 1e6]:
            self._on[key[0], self.tracks[key][0]].discard(key[1])
            del self.tracks[key]
        for key in [k for k, rows in self.waiting.items() if now_us - rows[-1][0] > r.track_s * 1e6]:
            del self.waiting[key]
        self._due = self.next_due()

    def next_due(self) -> int | None:
        """First moment (us) after which something here has expired."""
        r = self.rules
        p = self.pools
        due = [float(p.seen[p.gids >= 0].min()) + r.expiry_s * 1e6] if p.slots else []
        due += [seen + r.track_s * 1e6 for _, seen in self.tracks.values()] + [rows[-1][0] + r.track_s * 1e6 for rows in self.waiting.values()]
        return int(min(due)) if due else None

    def _best(self, possible: list[tuple[float, int, float]], attributes, colour, camera: str, now: int) -> tuple[int | None, float]:
        r, scored, top = self.rules, [], -np.inf
        for rough, gid, s in possible:
            if rough < top - r.margin - 1e-6:  # no runner-up that could come near
                break
            e = self.entries[gid]
            if vetoed(r, e.attributes, attributes):
                continue
            if now - e.last_us <= r.recent_s * 1e6:
                s = min(1.0, s + r.bonus)
            shade = 0.5 if colour is None or e.colour is None else min(1.0, max(0.0, float(colour @ e.colour)))
            w = (0.80, 0.15, 0.05) if e.camera_id == camera else (0.70, 0.25, 0.05)
            scored.append((w[0] * s + w[1] * shade + w[2] * _alike(attributes, e.attributes), gid))
            top = max(top, scored[-1][0])
        scored.sort(key=lambda x: (-x[0], x[1]))
        if not scored:
            return None, 0.0
        score, gid = scored[0]
        need = r.threshold + (r.cross_camera if self.entries[gid].camera_id != camera else 0.0)
        unclear = len(scored) > 1 and scored[1][0] >= need and score - scored[1][0] < r.margin
        return (None, 0.0) if score < need or unclear else (gid, score)

    def _held(self, gid: int, camera: str, track: int, now: int) -> bool:
        e = self.entries[gid]
        if self._on.get((camera, gid), set()) - {track}:
            return True
        return e.camera_id == camera and now - e.last_us < self.rules.guard_s * 1e6

    def see(self, camera: str, track: int, now: int, v: np.ndarray, sharpness: float, attributes, colour) -> tuple[int, str] | None:
        """The decision that this row of a track leads to, if any."""
        self.forget(now)
        r, key = self.rules, (camera, track)
        due = int(now + min(r.expiry_s, r.track_s) * 1e6)  # of what this row touches
        self._due = due if self._due is None else min(self._due, due)
        if key in self.tracks:
            gid = self.tracks[key][0]
            self.tracks[key] = gid, now
            e = self.entries.get(gid)
            if e is not None:
                near = self.pools.own(gid, v)
                if np.sort(near)[-3:].mean() >= r.drift:
                    self._take(gid, now, v, sharpness, attributes, colour, near)
            return None
        rows = self.waiting.setdefault(key, [])
        rows.append((now, v, sharpness, attributes))
        best, top = None, 0.0
        asked = [(x[1], x[3]) for x in rows]
        sharpest = max(rows, key=lambda x: x[2])
        if len(rows) >= r.best_of:
            weights = np.array([max(x[2], 0.1) for x in rows])
            mean = (np.stack([x[1] for x in rows]) * (weights / weights.sum())[:, None]).sum(axis=0)
            asked.append((unit(mean) if np.linalg.norm(mean) > 1e-8 else rows[0][1], sharpest[3]))
        possible = self.pools.possible(r, [x[0] for x in asked], [x[1] for x in asked], colour, camera, now)
        for (_, probs), some in zip(asked, possible, strict=True):
            gid, score = self._best(some, probs, colour, camera, now)
            if gid is not None and score > top:
                best, top = gid, score
        if best is not None and not self._held(best, camera, track, now):
            return self._link(key, best, "match", now, sharpest, attributes, colour)
        if len(rows) < r.window:
            return None
        p = self.pools
        like = p.like_of(p.gids[(p.gids >= 0) & (now - p.seen <= r.recent_s * 1e6)].tolist(), sharpest[1])
        lately = [g for g, s in like.items() if s >= r.rescue and not vetoed(r, self.entries[g].attributes, attributes)]
        saved = max(lately, key=lambda g: (like[g], -g), default=None)
        if saved is not None and not self._held(saved, camera, track, now):
            return self._link(key, saved, "rescue", now, sharpest, attributes, colour)
        age = now - p.seen
        pool = p.gids[(p.gids >= 0) & (p.cameras == p.numbers.get(camera, -2)) & (age > r.closed_from_s * 1e6) & (age < r.closed_to_s * 1e6)].tolist()
        pool = [g for g in pool if not self._held(g, camera, track, now) and not vetoed(r, self.entries[g].attributes, attributes)]
        like = p.like_of(pool, sharpest[1])
        closed = max(pool, key=lambda g: (like[g], -g), default=None)
        if closed is not None and like[closed] >= (r.closed_alone if len(pool) == 1 else r.closed_several):
            return self._link(key, closed, "closed", now, sharpest, attributes, colour)
        gid, self.next_gid = self.next_gid, self.next_gid + 1
        self.entries[gid] = Entry(camera, now, 1, sharpest[1], [sharpest[1]], [sharpest[2]], attributes, colour)
        self.pools.put(gid, self.entries[gid])
        return self._settle(key, gid, "new", now)

    def _take(self, gid: int, now: int, v: np.ndarray, sharpness: float, attributes, colour, near: np.ndarray) -> None:
        e = self.entries[gid]
        new = e.take(self.rules, now, v, sharpness, attributes, colour, float(near[1:].max()))
        self.changed.add(gid)
        (self.pools.put if new else self.pools.touch)(gid, e)

    def _link(self, key, gid: int, how: str, now: int, sharpest, attributes, colour) -> tuple[int, str]:
        self._take(gid, now, sharpest[1], sharpest[2], attributes, colour, self.pools.own(gid, sharpest[1]))
        return self._settle(key, gid, how, now)

    def _settle(self, key, gid: int, how: str, now: int) -> tuple[int, str]:
        self.tracks[key] = gid, now
        self._on.setdefault((key[0], gid), set()).add(key[1])
        self.waiting.pop(key, None)
        self.changed.add(gid)
        return gid, how


def _vector(x) -> np.ndarray | None:
    return None if x is None else np.asarray(x, dtype=float)


class _Processor(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "gid long", ENTRY)
        self.tracks = handle.getMapState("tracks", "camera_id string, track_id long", "gid long, seen_us long")
        self.waiting = handle.getListState("waiting", WAITING)
        self.next_gid = handle.getValueState("next_gid", "gid long")

    def _load(self) -> Gallery:
        entries = {}
        for k, e in self.entries.iterator():
            entries[k[0]] = Entry(e[0], e[1], e[2], _vector(e[3]), [_vector(a) for a in e[4]], list(e[5]), _vector(e[6]), _vector(e[7]))
        self._stored = {(k[0], k[1]): (v[0], v[1]) for k, v in self.tracks.iterator()}
        waiting: dict[tuple[str, int], list[tuple]] = {}
        for w in self.waiting.get():
            waiting.setdefault((w[0], w[1]), []).append((w[2], _vector(w[3]), w[4], _vector(w[5])))
        next_gid = self.next_gid.get()[0] if self.next_gid.exists() else 1
        return Gallery(self.rules, entries, dict(self._stored), waiting, next_gid)

    def _save(self, g: Gallery) -> None:
        plain = lambda v: None if v is None else [float(x) for x in v]
        for gid in g.changed:
            e = g.entries.get(gid)
            if e is None:
                self.entries.removeKey((gid,))
            else:
                self.entries.updateValue((gid,), (e.camera_id, int(e.last_us), int(e.hits), plain(e.prototype), [plain(a) for a in e.anchors], plain(e.qualities), plain(e.attributes), plain(e.colour)))
        for key in self._stored.keys() - g.tracks.keys():
            self.tracks.removeKey(key)
        for key, (gid, seen) in g.tracks.items():
            if self._stored.get(key) != (gid, seen):
                self.tracks.updateValue(key, (int(gid), int(seen)))
        rows = [(c, int(t), int(ts), plain(v), float(q), plain(a)) for (c, t), held in g.waiting.items() for ts, v, q, a in held]
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()
        self.next_gid.update((int(g.next_gid),))
        due = g.next_due()
        if due is not None:
            for ms in self.handle.listTimers():
                self.handle.deleteTimer(ms)
            self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g, out = self._load(), []
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "camera_id", "track_id"], kind="stable")
        for r in pdf.itertuples(index=False):
            told = g.see(r.camera_id, int(r.track_id), int(r.ts_us), _vector(r.embedding), float(r.sharpness), _vector(r.attributes), _vector(r.colour))
            if told is not None:
                out.append((key[0], r.camera_id, int(r.track_id), int(r.ts_us), *told))
        self._save(g)
        yield pd.DataFrame(out, columns=["store", "camera_id", "track_id", "ts_us", "gid", "how"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        g = self._load()
        g.forget(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(g)
        yield pd.DataFrame(columns=["store", "camera_id", "track_id", "ts_us", "gid", "how"])

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def online_assignment(tracks: DataFrame, rules: Rules | None = None, late: str = LATE) -> DataFrame:
    """(store, camera_id, track_id, ts_us, gid, how): a row per track and decision, as it is made.

    tracks is a stream of store, camera_id, track_id, time, ts_us, embedding,
    sharpness, attributes and colour (the last two may be NULL).  A track waits
    for up to `window` rows for a clear match of one of its rows or of their
    mean (`match`), then takes a recent identity from a lower score (`rescue`),
    one that its camera lost lately (`closed`), or a `new` id.  Its later rows
    enrich the identity, but for those that drifted to somebody else.  Rows of a
    batch are looked at in time order, rows older than the watermark are dropped.
    """
    columns = ["store", "camera_id", "track_id", "time", "ts_us", "embedding", "sharpness", "attributes", "colour"]
    rows = tracks.withWatermark("time", late).select(*columns)
    return rows.groupBy("store").transformWithStateInPandas(_Processor(rules or Rules()), DECIDED, "Append", "EventTime")


def labelled(rules: Rules, labels: Sequence[str]) -> Rules:
    return replace(rules, labels=tuple(labels))
