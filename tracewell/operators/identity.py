"""Identity matching on embedding vectors (L2-normalised arrays of double).

Query x item similarities are computed block by block: items are dealt into
blocks by their identity, queries go to every block in parts, and a task
multiplies one part by one block.  Neither side is ever whole in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.gates import grouped_fold, sorted_scan
from tracewell.operators.graph import components
from tracewell.sources.shared import written

BLOCK_ROWS, PART_ROWS = 20_000, 5_000
GROUP_ROWS = 20_000  # queries of a part where all anchors ask
TILE = 1 << 21  # scores (16 MB) that a task holds at once
ITEM_ROWS, ASK_ROWS = 1 << 17, 1 << 16  # anchors and queries that meet in one task of `judged`
LOOKED = 1 << 16  # pairs whose looks are compared at once
PAIR_ASKS, PAIR_ITEMS = 256, 1 << 13  # anchors of a and of b that are multiplied at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _blocks(queries: DataFrame, items: DataFrame, block_rows: int, part_rows: int, group: str = "query_id", own: str | None = None) -> DataFrame:
    """(block, part, query, id, g, e, o): every query with every block and every item with every part."""
    blocks = max(1, -(-items.count() // block_rows))
    parts = max(1, -(-queries.count() // part_rows))
    name = F.col(own) if own else F.lit(None)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    q = queries.select(F.lit(True).alias("query"), F.col("query_id").cast("long").alias("id"), F.col(group).cast("long").alias("g"), F.col("embedding").alias("e"), name.cast("long").alias("o"))
    i = items.select(F.lit(False).alias("query"), F.col("gid").cast("long").alias("id"), F.col("gid").cast("long").alias("g"), F.col("embedding").alias("e"), name.cast("long").alias("o"))
    q = q.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).withColumn("block", every(blocks))
    i = i.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", every(parts))
    return q.unionByName(i)


@dataclass
class Side:
    """Queries or items of a task: ids, groups, names of rows (see `own`) and vectors."""

    id: np.ndarray
    g: np.ndarray
    o: np.ndarray
    e: np.ndarray

    def take(self, at) -> Side:
        return Side(self.id[at], self.g[at], self.o[at], self.e[at])

    def __len__(self) -> int:
        return len(self.id)


def sides(batches: Iterator[pd.DataFrame]) -> tuple[Side, Side]:
    """(queries by group, items by id) of one block and part; vectors are packed batch by batch."""
    held: dict[bool, list] = {True: [], False: []}
    for pdf in batches:
        for which, rows in pdf.groupby("query"):
            held[bool(which)].append((rows["id"].to_numpy(), rows["g"].to_numpy(), rows["o"].to_numpy(), np.stack(rows["e"].to_numpy())))
    made = []
    for which in (True, False):
        parts = held[which]
        side = Side(*(np.concatenate([p[i] for p in parts]) if parts else np.zeros((0, 0) if i == 3 else 0) for i in range(4)))
        made.append(side.take(np.argsort(side.g, kind="stable")))
    return made[0], made[1]


def _stretches(q: Side, n: int) -> Iterator[Side]:
    """Queries in about n stretches that hold whole groups."""
    first = np.searchsorted(q.g, np.unique(q.g[:: max(1, len(q) // n)]), side="left")
    for a, z in zip(first, [*first[1:], len(q)], strict=True):
        yield q.take(slice(a, z))


def mask_own(s: np.ndarray, q: Side, a: Side) -> None:
    """-inf where an item is named like the query itself."""
    order = np.argsort(a.o, kind="stable")
    names = a.o[order]
    first, last = np.searchsorted(names, q.o, side="left"), np.searchsorted(names, q.o, side="right")
    for i in np.flatnonzero(last > first):
        s[i, order[first[i] : last[i]]] = -np.inf


def _tiles(q: Side, a: Side, whole: bool, own: str | None) -> Iterator[tuple[Side, np.ndarray]]:
    """Queries in tiles of bounded size with their similarities; with `whole` a query group stays together.

    A row that is named like the query itself (`own`) is no item of it: its similarity is -inf.
    """
    items = a.e.T
    step, at = max(1, TILE // items.shape[1]), 0
    while at < len(q):
        end = min(at + step, len(q))
        if whole and end < len(q):
            start = int(np.searchsorted(q.g, q.g[end]))
            end = start if start > at else int(np.searchsorted(q.g, q.g[end], side="right"))
        part = q.take(slice(at, end))
        s = part.e @ items
        s[np.isnan(s)] = -np.inf
        if own is not None:
            mask_own(s, part, a)
        yield part, s
        at = end


def _best_mean(layers: Iterator[np.ndarray], k: int) -> np.ndarray:
    """Mean of the k largest finite values at each place of equally shaped layers; -inf where there is none."""
    best: list[np.ndarray] = []
    for x in layers:
        for i, b in enumerate(best):
            best[i], x = np.maximum(b, x), np.minimum(b, x)
        if len(best) < k:
            best.append(np.array(x))
    held = [np.isfinite(b) for b in best]
    if all(h.all() for h in held):
        total = best[-1]
        for b in best[-2::-1]:
            total += b
        total /= len(best)
        return total
    n = np.sum(held, axis=0)
    total = np.zeros(best[0].shape)
    for b, h in zip(reversed(best), reversed(held), strict=True):
        np.add(total, b, out=total, where=h)
    return np.where(n > 0, total / np.maximum(n, 1), -np.inf)


class Places:
    """Where the rows of each id lie: ids with equally many rows, the first row of each, then the second, and so on."""

    def __init__(self, of: np.ndarray):
        """`of`: ids, in order."""
        ids, first, counts = np.unique(of, return_index=True, return_counts=True)
        self.sizes, rows, self.ids = [], [], []
        for w in np.unique(counts):
            at = np.flatnonzero(counts == w)
            self.sizes.append((int(w), len(at)))
            rows.append((first[at][None, :] + np.arange(w)[:, None]).ravel())
            self.ids.append(ids[at])
        self.order = np.concatenate(rows)
        self.ids = np.concatenate(self.ids)

    def best_mean(self, s: np.ndarray, k: int) -> np.ndarray:
        """Per row of s, whose columns are in this order: the mean of the k best of each id."""
        out, at = [], 0
        for w, n in self.sizes:
            out.append(_best_mean((s[:, at + j * n : at + (j + 1) * n] for j in range(w)), k))
            at += w * n
        return np.concatenate(out, axis=1)


def score_rows(ids: np.ndarray, gids: np.ndarray, out: np.ndarray, least: float | None, ordered: bool = False) -> Iterator[pd.DataFrame]:
    """(query_id, gid, score) of the finite scores, from `least` on."""
    keep = np.isfinite(out) if least is None else out >= least
    if ordered:
        keep &= ids[:, None] < gids
    r, c = np.nonzero(keep)
    if len(r):
        yield pd.DataFrame({"query_id": ids[r], "gid": gids[c], "score": out[r, c]})


def identity_scores(
    queries: DataFrame,
    anchors: DataFrame,
    k: int = 3,
    least: float | None = None,
    block_rows: int = BLOCK_ROWS,
    part_rows: int | None = None,
    group: str | None = None,
    own: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """(query_id, gid, score): mean of the k best similarities with the identity's anchors.

    queries: query_id, embedding; anchors: gid, embedding.  Pairs below `least`
    are left out in the task that scores them.  An identity's anchors lie in one
    block.  With `group` (a column of the queries) query_id is the group, and the
    score the mean of the k best of its queries' scores.  With `own` (a whole
    number column of both) an anchor that is the query itself doesn't count.
    With `ordered` only pairs with query_id (or group) < gid are scored.  A task
    returns its scores tile by tile.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, a = sides(batches)
        if not len(q) or not len(a):
            return
        for some in _stretches(q, 16) if ordered else [q]:
            # of ordered pairs only later items can be met
            later = a.take(slice(int(np.searchsorted(a.g, some.g[0], side="right")), None)) if ordered else a
            if not len(later):
                continue
            places = Places(later.g)
            for part, s in _tiles(some, later.take(places.order), group is not None, own):
                out, ids = places.best_mean(s, k), part.id
                if group is not None:
                    asked = Places(part.g)
                    out, ids = asked.best_mean(out[asked.order].T, k).T, asked.ids
                yield from score_rows(ids, places.ids, out, least, ordered)

    part_rows = part_rows or (PART_ROWS if group is None else GROUP_ROWS)
    both = _blocks(queries, anchors, block_rows, part_rows, group or "query_id", own)
    return both.groupBy("block", "part").applyInPandas(score, "query_id long, gid long, score double")


def best_of(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first, equal ones by column."""
    if s.shape[1] <= k:
        return np.argsort(-s, axis=1, kind="stable")
    # all that reach the k-th value, so that ties are settled by column
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    out = np.empty((len(s), k), dtype=np.int64)
    for i, row in enumerate(s):
        at = np.flatnonzero(row >= least[i])
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS, own: str | None = None) -> DataFrame:
    """(query_id, gid, score, rank): the k items nearest to each query; ties by item.  `own` as in identity_scores."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, a = sides(batches)
        if not len(q) or not len(a):
            return
        for part, s in _tiles(q, a, False, own):
            yield best_rows(part.id, a.id, s, k)

    local = _blocks(queries, items, block_rows, part_rows, own=own).groupBy("block", "part").applyInPandas(best, "query_id long, gid long, score double")
    return ranked(local, k)


def best_rows(ids: np.ndarray, items: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, gid, score) of the k best finite similarities of each query; items in order."""
    top = best_of(s, k)
    rows = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "gid": items[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})
    return rows[np.isfinite(rows["score"])]


def ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fused_score(embedding: Column, colour: Column, attributes: Column, same_camera: Column) -> Column:
    """Weighted score; a missing part counts 0.5, colour is held within 0..1."""
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.5))
    col = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part(colour)))
    return F.when(same_camera, 0.80 * part(embedding) + 0.15 * col + 0.05 * part(attributes)).otherwise(0.70 * part(embedding) + 0.25 * col + 0.05 * part(attributes))


def clothing_veto(gender_a: Column, gender_b: Column, colours: list[tuple[Column, Column]], gender_gap: float = 0.60, strong: float = 0.45, least: float = 0.35) -> Column:
    """True where two people can't be one: genders far apart, or clearly different upper or lower colours."""
    veto = F.abs(gender_a - gender_b) > gender_gap
    for a, b in colours:
        size = F.sqrt(dot(a, a) * dot(b, b))
        veto = veto | ((F.array_max(a) >= strong) & (F.array_max(b) >= strong) & (F.try_divide(dot(a, b), size) < least))
    return F.coalesce(veto, F.lit(False))


@dataclass(frozen=True)
class Look:
    """Places in the attribute probabilities: gender, and the colours of each part of the clothes; and what the veto asks."""

    gender: int | None = None
    parts: tuple[tuple[int, ...], ...] = ()
    gender_gap: float = 0.60
    strong: float = 0.45
    least: float = 0.35

    def veto(self, a: Column, b: Column) -> Column:
        """True where both have probabilities that can't be one person's."""
        g = lambda x: x[self.gender] if self.gender is not None else F.lit(0.0)
        part = lambda x, p: F.array(*[x[i] for i in p])
        veto = clothing_veto(g(a), g(b), [(part(a, p), part(b, p)) for p in self.parts], self.gender_gap, self.strong, self.least)
        return a.isNotNull() & b.isNotNull() & veto


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def with_appearance(scores: DataFrame, queries: DataFrame, gallery: DataFrame, look: Look) -> DataFrame:
    """Scores (query_id, gid, ...) with veto, and the similarities of colour and attributes (NULL where a side has none).

    queries: query_id, attributes, colour; gallery: gid, attributes, colour.
    """
    q = queries.select(F.col("query_id").alias("_q"), F.col("attributes").alias("_qa"), F.col("colour").alias("_qc"))
    g = gallery.select(F.col("gid").alias("_g"), F.col("attributes").alias("_ga"), F.col("colour").alias("_gc"))
    both = scores.join(q, F.col("query_id") == F.col("_q")).join(g, F.col("gid") == F.col("_g"))
    told = both.withColumn("veto", look.veto(F.col("_qa"), F.col("_ga"))).withColumn("colour", dot(F.col("_qc"), F.col("_gc"))).withColumn("attributes", cosine(F.col("_qa"), F.col("_ga")))
    return told.drop("_q", "_qa", "_qc", "_g", "_ga", "_gc")


def _no_veto(scores: DataFrame) -> DataFrame:
    return scores.where(~F.coalesce("veto", F.lit(False))) if "veto" in scores.columns else scores


def best_match(scores: DataFrame, threshold: float = 0.42, margin: float = 0.03, bonus: float = 0.12) -> DataFrame:
    """(query_id, gid, score) of queries with a clear best identity.

    scores: query_id, gid, score, recent, same_camera, and what with_appearance
    adds.  Vetoed identities are no candidates.  Recent ones get a bonus (up to
    1.0), then embedding, colour and attributes make the fused score (a missing
    part is neutral).  Another camera needs 0.02 more; no decision where the
    runner-up passes what the best one needs, within the margin.
    """
    part = lambda c: F.col(c) if c in scores.columns else F.lit(None)
    lifted = F.least(F.lit(1.0), F.col("score") + F.when(F.col("recent"), bonus).otherwise(0.0))
    s = _no_veto(scores).withColumn("score", fused_score(lifted, part("colour"), part("attributes"), F.col("same_camera")))
    return clear_best(s, threshold, margin)


def clear_best(scores: DataFrame, threshold: float = 0.42, margin: float = 0.03) -> DataFrame:
    """(query_id, gid, score) of queries with a clear best identity, of fused scores (query_id, gid, score, same_camera)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    top = scores.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rank = 1")
    need = F.lit(threshold) + F.when(F.col("same_camera"), 0.0).otherwise(0.02)
    unclear = F.coalesce((F.col("second") >= need) & (F.col("score") - F.col("second") < margin), F.lit(False))
    return top.where((F.col("score") >= need) & ~unclear).select("query_id", "gid", "score")


def least_similarity(threshold: float = 0.42, bonus: float = 0.12) -> float:
    """Below this no similarity can reach the threshold, whatever bonus, colour and attributes add."""
    return min((threshold - 0.20) / 0.80, (threshold - 0.30) / 0.70) - bonus


class Looks:
    """Cameras (numbers, -1 for none), attributes and colours of asks or of identities, as a task compares them.

    Values lie place by place (`x`) with how many a row has (`n`, -1: none, or one is missing) and its length squared (`sq`).
    """

    def __init__(self, rows: pd.DataFrame, cameras: np.ndarray, look: Look):
        self.cameras = cameras
        places = [p for part in look.parts for p in part] + ([] if look.gender is None else [look.gender])
        raw, self.x, self.n = _values(rows["attributes"], 1 + max(places, default=0))
        _, self.colour_x, self.colour_n = _values(rows["colour"])
        self.sq = _squares(self.x)
        self.gender = np.full(len(rows), np.nan) if look.gender is None else raw[look.gender]
        # of each part of the clothes: its values, their length squared, and whether they are there and one is strong
        at = [list(p) for p in look.parts]
        self.parts = [(self.x[p], _squares(self.x[p]), ~np.isnan(raw[p]).any(0) & (np.max(raw[p], axis=0) >= look.strong)) for p in at]

    def take(self, at: slice) -> Looks:
        new = object.__new__(Looks)
        new.__dict__.update({k: v[..., at] for k, v in vars(self).items() if k != "parts"}, parts=[tuple(v[..., at] for v in p) for p in self.parts])
        return new


def _values(column: pd.Series, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays place by place in one width, with NaN and with 0 where nothing is, and how many values each has (-1: none, or one is missing)."""
    held = [None if x is None else np.asarray(x, dtype=float) for x in column]
    raw = np.full((max([least, *(len(x) for x in held if x is not None)]), len(held)), np.nan)
    for i, x in enumerate(held):
        if x is not None:
            raw[: len(x), i] = x
    n = np.array([-1 if x is None or np.isnan(x).any() else len(x) for x in held], dtype=np.int64)
    return raw, np.where(np.isnan(raw), 0.0, raw), n


def _squares(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for v in x:
        out += v * v
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all columns, added place by place as `dot` does."""
    out, one = np.zeros((a.shape[1], b.shape[1])), np.empty((a.shape[1], b.shape[1]))
    for x, y in zip(a, b, strict=False):
        np.multiply(x[:, None], y, out=one)
        out += one
    return out


def _cosines(a: np.ndarray, b: np.ndarray, sq_a: np.ndarray, sq_b: np.ndarray) -> np.ndarray:
    """Cosines of all columns, NaN where one has no length."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return _dots(a, b) / np.sqrt(sq_a[:, None] * sq_b)


def vetoes(a: Looks, b: Looks, look: Look) -> np.ndarray:
    """Look.veto of all pairs."""
    veto = np.abs(a.gender[:, None] - b.gender) > look.gender_gap
    for (x, sq_x, strong_x), (y, sq_y, strong_y) in zip(a.parts, b.parts, strict=True):
        if strong_x.any():
            veto |= (_cosines(x, y, sq_x, sq_y) < look.least) & strong_y & strong_x[:, None]
    return veto


def fused_scores(s: np.ndarray, a: Looks, b: Looks, same: np.ndarray) -> np.ndarray:
    """fused_score of all pairs."""
    c = np.clip(_dots(a.colour_x, b.colour_x), 0.0, 1.0)
    c[(a.colour_n[:, None] != b.colour_n) | (b.colour_n < 0)] = 0.5
    t = _cosines(a.x, b.x, a.sq, b.sq)
    t[(a.n[:, None] != b.n) | (b.n < 0) | np.isnan(t)] = 0.5
    return np.where(same, 0.80 * s + 0.15 * c + 0.05 * t, 0.70 * s + 0.25 * c + 0.05 * t)


def _same_camera(a: Looks, b: Looks) -> np.ndarray:
    return (a.cameras[:, None] == b.cameras) & (b.cameras >= 0)


def judged(
    queries: DataFrame,
    asks: DataFrame,
    anchors: DataFrame,
    gallery: DataFrame,
    judge: Callable[[np.ndarray, np.ndarray, Looks, np.ndarray, Looks, np.ndarray], Iterator[tuple[np.ndarray, ...]]],
    schema: str,
    look: Look,
    k: int = 3,
    own: str | None = None,
    block_rows: int = ITEM_ROWS,
    part_rows: int = ASK_ROWS,
) -> DataFrame:
    """What `judge` makes of the asks and the identities of one task: no pair leaves the task that scores it.

    queries: query_id, embedding; asks: ask_id, query_id, camera_id, attributes, colour (a query may be asked with
    several looks); anchors: gid, embedding; gallery: gid (once each), camera_id, attributes, colour, chosen (whatever
    the judge calls so); `own` as in identity_scores.  The judge gets ids of asks, their scores (ask x identity: means of
    the k best similarities, -inf without anchors), the asks' looks, the identities in order, their looks and `chosen`,
    and gives columns of the schema.
    In attributes and colours NaN counts as missing, like NULL; a query or anchor without embedding is left out.

    Blocks and parts are as large as a task can hold, and more parts are made only until every core has a task: so
    a row is copied to few tasks.
    """
    spark = queries.sparkSession
    n = queries.count()
    blocks = max(1, -(-anchors.count() // block_rows))
    parts = max(1, -(-n // part_rows), min(-(-n // 1000), -(-spark.sparkContext.defaultParallelism // blocks)))
    name = lambda df: (F.col(own) if own else F.lit(None)).cast("long").alias("o")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    looks = [F.col("camera_id").cast("string").alias("camera_id"), F.col("attributes").cast("array<double>").alias("attributes"), F.col("colour").cast("array<double>").alias("colour")]
    bare = [none("camera_id", "string"), none("attributes", "array<double>"), none("colour", "array<double>")]
    no_vector, not_chosen = [none("o", "long"), none("e", "array<double>")], none("chosen", "int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    q = queries.select(F.lit("query").alias("kind"), F.col("query_id").cast("long").alias("id"), F.col("query_id").cast("long").alias("of"), name(queries), F.col("embedding").alias("e"), *bare, not_chosen).where("e is not null")
    x = asks.select(F.lit("ask").alias("kind"), F.col("ask_id").cast("long").alias("id"), F.col("query_id").cast("long").alias("of"), *no_vector, *looks, not_chosen)
    a = anchors.select(F.lit("anchor").alias("kind"), F.col("gid").cast("long").alias("id"), F.col("gid").cast("long").alias("of"), name(anchors), F.col("embedding").alias("e"), *bare, not_chosen).where("e is not null")
    g = gallery.select(F.lit("identity").alias("kind"), F.col("gid").cast("long").alias("id"), F.col("gid").cast("long").alias("of"), *no_vector, *looks, F.col("chosen").cast("int").alias("chosen"))
    asking = q.unionByName(x).withColumn("part", dealt("of", parts)).withColumn("block", every(blocks))
    asked = a.unionByName(g).where("id is not null").withColumn("block", dealt("of", blocks)).withColumn("part", every(parts))

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {"query": [], "ask": [], "anchor": [], "identity": []}
        for pdf in batches:
            for kind, rows in pdf.groupby("kind"):
                if kind in ("query", "anchor"):
                    held[kind].append((rows["id"].to_numpy(dtype=np.int64), rows["o"].to_numpy(dtype=np.int64 if own else float), np.stack(rows["e"].to_numpy())))
                else:
                    held[kind].append(rows[["id", "of", "camera_id", "attributes", "colour", "chosen"]])
        if not held["query"] or not held["ask"] or not held["identity"]:
            return

        def side(kind: str) -> Side:
            if not held[kind]:
                return Side(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)))
            ids, o, e = (np.concatenate(p) for p in zip(*held.pop(kind), strict=True))
            at = np.argsort(ids, kind="stable")
            return Side(ids[at], ids[at], o[at], e[at])

        queries, anchors = side("query"), side("anchor")
        queries.g = np.arange(len(queries))
        identities = pd.concat(held.pop("identity")).sort_values("id", kind="stable")
        gids, chosen = identities["id"].to_numpy(dtype=np.int64), identities["chosen"].to_numpy(dtype=float)
        asks = pd.concat(held.pop("ask")).sort_values(["of", "id"], kind="stable")
        asks = asks[np.isin(asks["of"], queries.id)]
        row, ids = np.searchsorted(queries.id, asks["of"].to_numpy(dtype=np.int64)), asks["id"].to_numpy(dtype=np.int64)
        cameras, _ = pd.factorize(pd.concat([identities["camera_id"], asks["camera_id"]]))
        theirs, own_looks = Looks(identities, cameras[: len(gids)], look), Looks(asks, cameras[len(gids) :], look)
        del identities, asks
        if len(anchors):
            places = Places(anchors.g)
            order = np.argsort(places.ids)
            at = np.minimum(np.searchsorted(places.ids[order], gids), len(order) - 1)
            # the column after the last one stands for no anchors
            column = np.where(places.ids[order][at] == gids, order[at], len(order))
            tiles = ((part.g, places.best_mean(s, k)) for part, s in _tiles(queries, anchors.take(places.order), False, own))
        else:
            column, tiles = np.zeros(len(gids), np.int64), ((queries.g, np.zeros((len(queries), 0))),)
        step, made = max(1, LOOKED // len(gids)), []
        for rows, means in tiles:
            means = np.concatenate([means, np.full((len(means), 1), -np.inf)], axis=1)[:, column]
            first, last = np.searchsorted(row, rows[0]), np.searchsorted(row, rows[-1], side="right")
            for i in range(first, last, step):
                some = slice(i, min(i + step, last))
                made += judge(ids[some], means[row[some] - rows[0]], own_looks.take(some), gids, theirs, chosen)
                if len(made) >= 500:
                    yield frame(made)
                    made = []
        if made:
            yield frame(made)

    def frame(made: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*made, strict=True)), strict=True)))

    return asking.unionByName(asked).groupBy("block", "part").applyInPandas(run, schema)


def match_judge(look: Look, threshold: float, bonus: float) -> Callable[..., Iterator[tuple[np.ndarray, ...]]]:
    """A judge (see `judged`) that gives the two best identities of each ask, of those that reach the threshold, as clear_best takes them."""
    least = least_similarity(threshold, bonus)

    def judge(ids, s, looks, gids, theirs, recent) -> Iterator[tuple[np.ndarray, ...]]:
        same = _same_camera(looks, theirs)
        fused = fused_scores(np.minimum(1.0, s + np.where(recent > 0, bonus, 0.0)), looks, theirs, same)
        fused[(s < least) | vetoes(looks, theirs, look)] = -np.inf
        at = np.arange(len(ids))
        for _ in range(2):
            best = np.argmax(fused, axis=1)  # the smallest of equals
            score = fused[at, best]
            enough = score >= threshold
            yield ids[enough], gids[best[enough]], score[enough], same[at, best][enough]
            fused[at, best] = -np.inf

    return judge


def best_matches(
    queries: DataFrame,
    asks: DataFrame,
    anchors: DataFrame,
    gallery: DataFrame,
    look: Look,
    threshold: float = 0.42,
    margin: float = 0.03,
    bonus: float = 0.12,
    k: int = 3,
    own: str | None = None,
    **sizes: int,
) -> DataFrame:
    """best_match of identity_scores with_appearance, as (ask_id, gid, score): a task returns the two best identities of an ask.

    Tables as in `judged`; chosen identities are recent ones.
    """
    judge = match_judge(look, threshold, bonus)
    found = judged(queries, asks, anchors, gallery, judge, "query_id long, gid long, score double, same_camera boolean", look, k, own, **sizes)
    return clear_best(found, threshold, margin).withColumnRenamed("query_id", "ask_id")


def rescue_matches(queries: DataFrame, asks: DataFrame, anchors: DataFrame, gallery: DataFrame, look: Look, threshold: float = 0.36, k: int = 3, own: str | None = None, **sizes: int) -> DataFrame:
    """rescue_match of identity_scores with_appearance, as (ask_id, gid, score): a task returns the best identity of an ask.

    Tables as in `judged`; chosen identities are recent ones.
    """

    def judge(ids, s, looks, gids, theirs, recent) -> Iterator[tuple[np.ndarray, ...]]:
        s[:, ~(recent > 0)] = -np.inf
        s[vetoes(looks, theirs, look)] = -np.inf
        best = np.argmax(s, axis=1)
        score = s[np.arange(len(ids)), best]
        enough = score >= threshold
        yield ids[enough], gids[best[enough]], score[enough]

    found = judged(queries, asks, anchors, gallery, judge, "ask_id long, gid long, score double", look, k, own, **sizes)
    w = Window.partitionBy("ask_id").orderBy(F.desc("score"), "gid")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def closed_world_matches(
    queries: DataFrame, asks: DataFrame, anchors: DataFrame, gallery: DataFrame, look: Look, alone: float = 0.15, several: float = 0.25, k: int = 3, own: str | None = None, **sizes: int
) -> DataFrame:
    """closed_world_match of identity_scores, as (ask_id, gid, score): a task returns how many candidates an ask has, and the best one.

    Tables as in `judged`; chosen identities are the pool (see `closed_pool`).
    """

    def judge(ids, s, looks, gids, theirs, pool) -> Iterator[tuple[np.ndarray, ...]]:
        candidate = _same_camera(looks, theirs) & (pool > 0) & ~vetoes(looks, theirs, look)
        s[~candidate] = -np.inf
        n, best = candidate.sum(axis=1), np.argmax(s, axis=1)
        some = n > 0
        yield ids[some], gids[best[some]], s[np.arange(len(ids)), best][some], n[some]

    found = judged(queries, asks, anchors, gallery, judge, "ask_id long, gid long, score double, n long", look, k, own, **sizes)
    best = F.max(F.struct("score", (-F.col("gid")).alias("i"))).alias("b")
    top = found.groupBy("ask_id").agg(best, F.sum("n").alias("n")).select("ask_id", (-F.col("b.i")).alias("gid"), "b.score", "n")
    return top.where(F.col("score") >= F.when(F.col("n") == 1, alone).otherwise(several)).select("ask_id", "gid", "score")


def closed_pool(as_of: int, near: int = 5, far: int = 120) -> Column:
    """Whether an identity is in a closed world: unassigned, and last seen near..far seconds ago."""
    age = (F.lit(as_of) - F.col("last_us")) / 1e6
    return F.coalesce(~F.col("assigned") & age.between(near, far), F.lit(False))


def active_on_camera_guard(matches: DataFrame, assignments: DataFrame, as_of: int, seconds: int = 15) -> DataFrame:
    """Matches (track_id, camera_id, gid) less those whose identity another track of the camera held within the seconds."""
    held = assignments.where(F.col("ts_us") > as_of - seconds * 1_000_000).select(F.col("camera_id").alias("_c"), F.col("gid").alias("_g"), F.col("track_id").alias("_t"))
    same = (F.col("camera_id") == F.col("_c")) & (F.col("gid") == F.col("_g")) & (F.col("track_id") != F.col("_t"))
    return matches.join(held, same, "left_anti")


def mean_vector(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """Weighted mean per key, of length 1 again; added element by element, so no key is gathered."""
    parts = rows.select(key, weight.alias("w"), F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    n = F.sqrt(dot(F.col("v"), F.col("v")))
    return whole.select(key, F.transform("v", lambda x: F.try_divide(x, n)).alias("embedding"))


def track_embedding(rows: DataFrame, key: str = "track_id", sharpness: str = "sharpness") -> DataFrame:
    """Mean by sharpness (0.1 at least)."""
    return mean_vector(rows, key, F.greatest(F.col(sharpness).cast("double"), F.lit(0.1)))


def prototype(anchors: DataFrame, k: int = 8) -> DataFrame:
    """Mean of each identity's k best anchors."""
    w = Window.partitionBy("gid").orderBy(F.desc("quality"), "ts")
    return mean_vector(anchors.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k), "gid", F.lit(1.0))


def anchor_bank(rows: DataFrame, max_anchors: int = 48, novelty: float = 0.72) -> DataFrame:
    """Anchors (gid, ts, quality, embedding) kept in time order.

    A vector joins if it is less than `novelty` similar to all kept ones; a
    full bank swaps its worst anchor for a better one.  A task holds one
    identity's bank, not its rows.
    """

    def step(bank, pdf: pd.DataFrame):
        bank = [] if bank is None else bank
        for row in pdf.itertuples(index=False):
            v = np.asarray(row.embedding)
            if bank and max(float(b[3] @ v) for b in bank) >= novelty:
                continue
            new = (row.gid, row.ts, row.quality, v)
            if len(bank) < max_anchors:
                bank.append(new)
            else:
                worst = min(range(len(bank)), key=lambda i: bank[i][2])
                if row.quality > bank[worst][2]:
                    bank[worst] = new
        return bank, None

    names = ["gid", "ts", "quality", "embedding"]
    return sorted_scan(rows.select(*names), ["gid"], ["ts"], step, "gid long, ts long, quality double, embedding array<double>", lambda bank: pd.DataFrame(bank, columns=names))


def ema_profile(rows: DataFrame, keep: float = 0.95, column: str = "embedding") -> DataFrame:
    """(gid, profile): running mean keep * old + (1 - keep) * new in time order.

    The n-th newest vector weighs (1 - keep) * keep^(n - 1), the oldest one the
    rest: a weighted sum, added element by element, so no identity is gathered.
    """
    w = Window.partitionBy("gid").orderBy(F.desc("ts"))
    last = F.row_number().over(w)
    oldest = F.lead("ts").over(w).isNull()
    weight = F.when(oldest, F.pow(F.lit(keep), last - 1)).otherwise((1 - keep) * F.pow(F.lit(keep), last - 1))
    parts = rows.select("gid", weight.alias("w"), column).select("gid", "w", F.posexplode(column).alias("i", "x"))
    sums = parts.groupBy("gid", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return sums.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("profile"))


def colour_profile(rows: DataFrame, keep: float = 0.80, sharp: float = 8.0, column: str = "colour") -> DataFrame:
    """(gid, profile): like ema_profile, but of sharp rows only (sharpness > `sharp`), and of length 1 again after each step."""

    def step(v, pdf: pd.DataFrame):
        for x in pdf[column]:
            x = np.asarray(x)
            if v is None:
                v = (x, pdf["gid"].iloc[0])
                continue
            mixed = keep * v[0] + (1 - keep) * x
            n = np.linalg.norm(mixed)
            v = (mixed / n if n > 1e-8 else mixed, v[1])
        return v, None

    sharp_rows = rows.where((F.col("sharpness") > sharp) & F.col(column).isNotNull()).select("gid", "ts", column)
    return sorted_scan(sharp_rows, ["gid"], ["ts"], step, "gid long, profile array<double>", lambda v: pd.DataFrame({"gid": [v[1]], "profile": [v[0]]}))


def drift_reject(updates: DataFrame, anchors: DataFrame, least: float = 0.32, k: int = 3, own: str | None = None) -> DataFrame:
    """Updates (query_id, gid, embedding) that are like their own identity: mean of the k best similarities.

    With `own` (a column of both) an anchor that is the update itself doesn't count.
    """
    a = anchors.select(F.col("gid").alias("_g"), F.col("embedding").alias("_e"), (F.col(own) if own else F.lit(None)).alias("_o"))
    same = F.col("gid") == F.col("_g")
    sims = updates.join(a, same & (F.col(own) != F.col("_o")) if own else same).select("query_id", "gid", dot(F.col("embedding"), F.col("_e")).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"))
    top = sims.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("query_id", "gid").agg(F.avg("s").alias("score"))
    return top.where(F.col("score") >= least)


def rescue_match(scores: DataFrame, recent: DataFrame, threshold: float = 0.36) -> DataFrame:
    """Best recently active identity of each query, from a lower threshold; vetoed ones don't count."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    s = _no_veto(scores).join(recent.select("gid"), "gid", "left_semi").where(F.col("score") >= threshold)
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "gid", "score")


def closed_world_match(
    scores: DataFrame, queries: DataFrame, gallery: DataFrame, as_of: int, near: int = 5, far: int = 120, alone: float = 0.15, several: float = 0.25, look: Look | None = None
) -> DataFrame:
    """Identities of the query's camera, unassigned and last seen near..far seconds ago: the only one
    needs `alone`, the best of several needs `several`.

    queries: query_id, camera_id; gallery: gid, camera_id, last_us, assigned.
    With `look`, both have attributes and colour, and vetoed identities are no candidates.
    """
    pool = gallery.where(closed_pool(as_of, near, far)).select("gid", "camera_id")
    # scores may leave out pairs below `alone`: candidates are counted on their own
    c = queries.select("query_id", "camera_id").join(pool, "camera_id").select("query_id", "gid")
    if look is not None:
        c = _no_veto(with_appearance(c, queries, gallery, look)).select("query_id", "gid")
    n = c.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("n"))
    c = c.join(scores.select("query_id", "gid", "score"), ["query_id", "gid"]).join(n, F.col("query_id") == F.col("_q"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    top = c.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return top.where(F.col("score") >= F.when(F.col("n") == 1, alone).otherwise(several)).select("query_id", "gid", "score")


def duplicate_pairs(anchors: DataFrame, gallery: DataFrame, as_of: int, threshold: float = 0.48, k: int = 3, active_s: int = 12, block_rows: int = ITEM_ROWS) -> DataFrame:
    """(a, b, score), a < b: identities whose fused score reaches the threshold.

    The embedding's part is the mean of the k best of a's anchors, each scored by
    its k best similarities with b's prototype and anchors.  Two identities that
    are both assigned, or both seen in the last `active_s` seconds, are never one.
    anchors: gid, embedding; gallery: gid (once each), prototype, camera_id, last_us,
    assigned, colour, attributes (the last two may be NULL; NaN in them counts as missing).

    Identities lie in blocks, ranges of gid of about `block_rows` anchors; a task takes two blocks,
    decides, and returns its duplicates.  No score of another pair leaves it.
    """
    spark = anchors.sparkSession
    # full marks for colour and attributes can't lift a lower score to the threshold
    possible = min((threshold - 0.20) / 0.80, (threshold - 0.30) / 0.70)
    n = anchors.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(-(-n // 1000), int(np.ceil(np.sqrt(2 * cores)))))
    # a row with the first gid of each block
    cuts = anchors.agg(F.percentile_approx("gid", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("id")))
    looks = ["camera_id", "attributes", "colour", "assigned", "fresh"]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(looks, ("string", "array<double>", "array<double>", "double", "double"), strict=True)]
    row = lambda kind, e: [F.lit(kind).alias("kind"), F.col("gid").cast("long").alias("id"), F.col(e).alias("e")]
    held = anchors.select(*row("anchor", "embedding"), *none).union(gallery.select(*row("prototype", "prototype"), *none)).where("e is not null")
    fresh = (F.col("last_us") > as_of - active_s * 1_000_000).cast("double")
    worn = gallery.select(
        F.lit("look").alias("kind"), F.col("gid").cast("long").alias("id"), F.lit(None).cast("array<double>").alias("e"), F.col("camera_id").cast("string").alias("camera_id"),
        F.col("attributes").cast("array<double>").alias("attributes"), F.col("colour").cast("array<double>").alias("colour"), F.col("assigned").cast("double").alias("assigned"), fresh.alias("fresh"),
    )
    rows = held.union(worn).where("id is not null").withColumn("t", block)
    first = rows.where("kind <> 'prototype'").select(F.lit("a").alias("side"), F.col("t").alias("i"), F.explode(F.sequence("t", F.lit(len(cuts)))).alias("j"), "kind", "id", "e", *looks)
    second = rows.select(F.lit("b").alias("side"), F.explode(F.sequence(F.lit(0), "t")).alias("i"), F.col("t").alias("j"), "kind", "id", "e", *looks)
    none_worn = pd.DataFrame({"id": np.zeros(0, np.int64), **{c: np.zeros(0, object) for c in looks}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors: dict[str, list] = {"a": [], "b": []}
        worn: dict[str, list] = {"a": [none_worn], "b": [none_worn]}
        for pdf in batches:
            for (side, look), some in pdf.groupby(["side", pdf["kind"] == "look"]):
                if look:
                    worn[side].append(some[["id", *looks]])
                else:
                    vectors[side].append((some["id"].to_numpy(dtype=np.int64), np.stack(some["e"].to_numpy())))
        if not vectors["a"] or not vectors["b"] or len(worn["a"]) < 2 or len(worn["b"]) < 2:
            return
        tables = {side: pd.concat(worn.pop(side)[1:]).sort_values("id", kind="stable") for side in ("a", "b")}
        cameras, _ = pd.factorize(pd.concat([t["camera_id"] for t in tables.values()]))
        seen = {"a": cameras[: len(tables["a"])], "b": cameras[len(tables["a"]) :]}

        def laid(side: str) -> tuple[Side, Callable[[np.ndarray], tuple[Looks, np.ndarray, np.ndarray]]]:
            """Vectors of identities that have a look, in order, and the looks of some of these, whether unassigned, and whether at rest."""
            ids, e = (np.concatenate(p) for p in zip(*vectors.pop(side), strict=True))
            t = tables.pop(side)
            own, assigned, fresh = (t[c].to_numpy(dtype=float) for c in ("id", "assigned", "fresh"))
            own, all_looks = t["id"].to_numpy(dtype=np.int64), Looks(t, seen[side], Look())
            at = np.argsort(ids, kind="stable")
            at = at[np.isin(ids[at], own)]

            def of(some: np.ndarray) -> tuple[Looks, np.ndarray, np.ndarray]:
                at = np.searchsorted(own, some)
                return all_looks.take(at), assigned[at] == 0, fresh[at] == 0

            return Side(ids[at], ids[at], np.zeros(len(at)), e[at]), of

        (q, looks_a), (items, looks_b) = laid("a"), laid("b")
        if not len(q) or not len(items):
            return
        later = []
        for some in _stretches(items, -(-len(items) // PAIR_ITEMS)):
            places = Places(some.g)
            later.append((some.g[-1], some.take(places.order), places, *looks_b(places.ids)))
        for asking in _stretches(q, -(-len(q) // PAIR_ASKS)):
            asked = Places(asking.g)
            worn_a, free_a, rest_a = looks_a(asked.ids)
            e = asking.e[asked.order]
            for last, some, places, worn_b, free_b, rest_b in later:
                if last <= asking.g[0]:
                    continue
                s = e @ some.e.T
                s[np.isnan(s)] = -np.inf
                out = asked.best_mean(places.best_mean(s, k).T, k).T
                keep = (out >= possible) & (asked.ids[:, None] < places.ids) & (free_a[:, None] | free_b) & (rest_a[:, None] | rest_b)
                if keep.any():
                    score = fused_scores(out, worn_a, worn_b, _same_camera(worn_a, worn_b))
                    r, c = np.nonzero(keep & (score >= threshold))
                    yield pd.DataFrame({"a": asked.ids[r], "b": places.ids[c], "score": score[r, c]})

    return first.union(second).groupBy("i", "j").applyInPandas(run, "a long, b long, score double")


def merge_identities(pairs: DataFrame, gallery: DataFrame) -> DataFrame:
    """(gid, kept, prototype): identities dropped into others, pair by pair in order of (a, b).

    pairs: a, b, and `veto` where given (such pairs are no merges); gallery: gid,
    hits, prototype.  The keeper has more hits (of equals a).  Pairs whose ends are
    gone already are skipped.  A keeper's prototype becomes the mean of both, of
    length 1.  Rows: every dropped identity with the last keeper (prototype NULL),
    and every keeper with itself and its new prototype.  Groups of linked pairs are
    independent, so each is folded alone; a prototype goes there once, not with every pair.
    """
    if "veto" in pairs.columns:
        pairs = pairs.where(~F.coalesce("veto", F.lit(False)))
    pairs = written(pairs.select("a", "b"), "pairs")
    group = components(pairs).select(F.col("node").alias("_n"), F.col("component").alias("c"))
    edges = pairs.join(group, F.col("a") == F.col("_n")).select("c", F.lit(True).alias("pair"), "a", "b", F.lit(None).cast("double").alias("hits"), F.lit(None).cast("array<double>").alias("prototype"))
    nodes = gallery.join(group, F.col("gid") == F.col("_n")).select("c", F.lit(False).alias("pair"), F.col("gid").alias("a"), F.col("gid").alias("b"), F.col("hits").cast("double").alias("hits"), "prototype")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[~pdf["pair"]]
        hits = dict(zip(nodes["a"], nodes["hits"], strict=True))
        own = {g: np.asarray(p) for g, p in zip(nodes["a"], nodes["prototype"], strict=True)}
        gone: dict[int, int] = {}
        pairs = pdf[pdf["pair"]]
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            if a not in own or b not in own:
                continue
            keep, drop = (a, b) if hits[a] >= hits[b] else (b, a)
            if keep in gone or drop in gone:
                continue
            gone[drop] = keep
            mean = (own[keep] + own[drop]) / 2
            n = np.linalg.norm(mean)
            own[keep] = mean / n if n > 0 else mean

        def root(x: int) -> int:
            while x in gone:
                x = gone[x]
            return x

        keepers = sorted(set(gone.values()) - set(gone))
        return pd.DataFrame([(x, root(x), None) for x in sorted(gone)] + [(x, x, own[x]) for x in keepers], columns=["gid", "kept", "prototype"])

    return grouped_fold(edges.union(nodes), ["c"], ["a", "b"], fold, "gid long, kept long, prototype array<double>")


def merged_gallery(merges: DataFrame, gallery: DataFrame, anchors: DataFrame, tracks: DataFrame, max_anchors: int = 48) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gallery (gid, hits, prototype), anchors (their best `max_anchors` by quality) and tracks after the merges of merge_identities."""
    m = merges.select(F.col("gid").alias("_g"), "kept", F.col("prototype").alias("_p"))
    moved = lambda df: df.join(m.drop("_p"), F.col("gid") == F.col("_g"), "left").withColumn("from", F.col("gid")).withColumn("gid", F.coalesce("kept", "gid")).drop("_g", "kept")
    hits = moved(gallery.select("gid", "hits")).groupBy("gid").agg(F.sum("hits").alias("hits"))
    shape = gallery.select(F.col("gid").alias("_o"), F.col("prototype").alias("_old"))
    g = hits.join(shape, F.col("gid") == F.col("_o")).join(m, F.col("gid") == F.col("_g"), "left").select("gid", "hits", F.coalesce("_p", "_old").alias("prototype"))
    w = Window.partitionBy("gid").orderBy(F.desc("quality"), F.col("from") != F.col("gid"), "from", "ts")
    best = moved(anchors).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_anchors).drop("_r", "from")
    return g, best, moved(tracks).drop("from")


def split_corrupted(anchors: DataFrame, least: float = 0.25) -> DataFrame:
    """(gid, ts, part): anchors of identities that hold two people, by the nearer of the first pair below `least`.

    An identity has at most as many anchors as its bank.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["embedding"].to_numpy())
        s = m @ m.T
        i, j = np.nonzero(np.triu(s < least, 1))
        if len(m) < 3 or not len(i):
            return pd.DataFrame(columns=["gid", "ts", "part"])
        return pd.DataFrame({"gid": pdf["gid"], "ts": pdf["ts"], "part": (s[:, j[0]] > s[:, i[0]]).astype(int)})

    return grouped_fold(anchors.select("gid", "ts", "embedding"), ["gid"], ["ts"], split, "gid long, ts long, part int")


def split_gallery(anchors: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors with their new gid as `to`, prototypes (gid, embedding) of both parts).

    The moved part of each split identity gets a new id after the largest, in the order of the old ones.
    """
    parts = split.select(F.col("gid").alias("_g"), F.col("ts").alias("_t"), "part")
    top = anchors.agg(F.max("gid").alias("top"))
    fresh = numbered(split.select("gid").distinct(), F.expr("gid div 4096"), ["gid"]).crossJoin(top).select(F.col("gid").alias("_n"), (F.col("top") + F.col("number")).alias("new"))
    rows = anchors.join(parts, (F.col("gid") == F.col("_g")) & (F.col("ts") == F.col("_t"))).drop("_g", "_t").join(fresh, F.col("gid") == F.col("_n")).drop("_n")
    rows = rows.withColumn("to", F.when(F.col("part") == 1, F.col("new")).otherwise(F.col("gid"))).drop("new")
    return rows, mean_vector(rows.select(F.col("to").alias("gid"), "embedding"), "gid", F.lit(1.0))


def numbered(df: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Adds `number`, from 1 without gaps: by bucket, then in order inside it (ranks per bucket, shifted by the counts before)."""
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    # a row per bucket
    shift = counts.select(F.col("_b").alias("_c"), (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_r", rank).join(shift, F.col("_b") == F.col("_c")).withColumn("number", F.col("_shift") + F.col("_r")).drop("_b", "_c", "_r", "_shift")


def prune_expired(gallery: DataFrame, as_of: int, expiry_s: int = 7200) -> DataFrame:
    return gallery.where(F.lit(as_of) - F.col("last_us") <= expiry_s * 1_000_000)


def active_gallery_size(gallery: DataFrame, as_of: int, expiry_s: int = 7200) -> DataFrame:
    """One row: how many identities aren't expired."""
    return prune_expired(gallery, as_of, expiry_s).agg(F.count("*").alias("identities"))


def assign_identities(
    tracks: DataFrame,
    anchors: DataFrame,
    gallery: DataFrame,
    assignments: DataFrame,
    recent: DataFrame,
    as_of: int,
    look: Look | None = None,
    threshold: float = 0.42,
    first: int = 7,
    rescue: float = 0.36,
) -> DataFrame:
    """(camera_id, track_id, gid, how): the identity of each track, from its first vectors, against the gallery as it is.

    Row by row of a track (up to `first`): the best match of any row so far and,
    from three rows, of their mean by sharpness, each with its veto and fused
    score (colours are those of the newest row, a mean has the attributes of its
    sharpest one); the first row at which that match isn't held by another active
    track of the camera decides (`match`).  Then, by the sharpest row and the
    newest one's veto, recent identities from a lower score (`rescue`), those of a
    closed world (`closed`), and at last a new id after the largest (`new`), in
    the order of camera and track.

    tracks: camera_id, track_id, ts, embedding, sharpness, attributes, colour (the
    last two may be NULL); anchors: gid, embedding (prototypes too); gallery: gid,
    camera_id, last_us, assigned, attributes, colour; assignments: camera_id, gid,
    track_id, ts_us; recent: gid.  A gallery that changes with every match is
    streaming.gallery.
    """
    look = look or Look()
    track = ["camera_id", "track_id"]
    w = Window.partitionBy(*track).orderBy("ts")
    rows = tracks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first)
    # what several later steps read is written once
    rows = written(rows.withColumn("query_id", F.xxhash64(*track, "n")), "rows")
    anchors, gallery = written(anchors.select("gid", "embedding"), "anchors"), written(gallery.select("gid", "camera_id", "last_us", "assigned", "attributes", "colour"), "gallery")
    # the first 3, 4, ... rows: their mean, and the attributes of the sharpest
    upto = rows.select(*track, F.explode(F.sequence(F.greatest("n", F.lit(3)), F.lit(first))).alias("m"), "embedding", "sharpness", "n", "attributes")
    longest = rows.groupBy(*track).agg(F.max("n").alias("most"))
    upto = upto.join(longest, track).where("m <= most").withColumn("query_id", F.xxhash64(*track, F.lit("mean"), "m"))
    means = track_embedding(upto, "query_id")
    sharpest = lambda value: F.max_by(value, F.struct("sharpness", (-F.col("n")).alias("i")))
    worn = upto.groupBy(*track, "m", "query_id").agg(sharpest("attributes").alias("attributes"))
    queries = written(rows.select("query_id", "embedding").union(means.select("query_id", "embedding")), "queries")

    # a row is asked again with each newer row's colours
    newer = rows.select(*track, F.col("n").alias("now"), F.col("colour"))
    asked = rows.select(*track, "n", "query_id", "attributes").join(newer, track).where("n <= now").select(*track, F.col("now").alias("n"), F.lit(False).alias("mean"), F.col("n").alias("i"), "query_id", "attributes", "colour")
    of_mean = worn.join(newer, track).where("m = now").select(*track, F.col("m").alias("n"), F.lit(True).alias("mean"), F.lit(0).alias("i"), "query_id", "attributes", "colour")
    asked = written(asked.union(of_mean).withColumn("ask_id", F.xxhash64("query_id", "n")), "asked")

    lately = gallery.join(recent.select("gid").distinct().withColumn("chosen", F.lit(True)), "gid", "left")
    found = best_matches(queries, asked, anchors, lately, look, threshold)
    found = found.join(asked.select("ask_id", *track, "n", "mean", "i"), "ask_id")
    # the earliest of equals, a row before the mean
    best = found.groupBy(*track, "n").agg(F.max(F.struct("score", (~F.col("mean")).alias("row"), (-F.col("i")).alias("i"), "gid")).alias("b"))
    free = active_on_camera_guard(best.select(*track, "n", "b.gid"), assignments, as_of)
    matched = written(free.groupBy(*track).agg(F.min_by("gid", "n").alias("gid")).withColumn("how", F.lit("match")), "matched")

    # the rest is tried once its window is full
    left = rows.join(matched, track, "left_anti")
    last = written(left.groupBy(*track).agg(sharpest("query_id").alias("query_id"), F.max_by("attributes", "n").alias("attributes"), F.max_by("colour", "n").alias("colour")), "last")
    vectors = rows.join(last.select("query_id"), "query_id", "left_semi").select("query_id", "embedding")
    asks = last.withColumn("ask_id", F.col("query_id"))
    on_camera = lambda df: df.join(asks.select("ask_id", *track), "ask_id").select(*track, "gid")
    saved = on_camera(rescue_matches(vectors, asks, anchors, lately, look, rescue))
    saved = written(active_on_camera_guard(saved, assignments, as_of).withColumn("how", F.lit("rescue")), "saved")
    held = assignments.where(F.col("ts_us") > as_of - 15_000_000).select("camera_id", "gid").distinct().withColumn("held", F.lit(True))
    pool = gallery.join(held, ["camera_id", "gid"], "left").withColumn("chosen", closed_pool(as_of) & F.col("held").isNull())
    closed = closed_world_matches(vectors, asks.join(saved, track, "left_anti"), anchors, pool, look)
    closed = on_camera(closed).withColumn("how", F.lit("closed"))
    known = written(matched.union(saved).union(closed), "known")
    top = anchors.agg(F.coalesce(F.max("gid"), F.lit(-1)).alias("top"))
    fresh = rows.select(*track).distinct().join(known, track, "left_anti")
    fresh = numbered(fresh, F.col("camera_id"), ["track_id"]).crossJoin(top)
    return known.union(fresh.select(*track, (F.col("top") + F.col("number")).alias("gid"), F.lit("new").alias("how")))
