"""Inverted file over unit vectors with an exact bound per list.

Items lie in lists around centroids; a list knows the largest angle between its
centroid and an item.  No item of it can be nearer to a query than the angle
between query and centroid less that radius, so lists that can't hold a better
item are skipped, and what comes out equals a full search.  Items of one gid lie
in one part of one list.  Parts of lists are dealt into shelves of about
`SHELF_ROWS` items, and queries in parts go to every shelf; a task multiplies
each query with those lists of its shelf that it needs, a tile at a time.

Centroids are fitted on a bounded sample (`SAMPLE` items, chosen by a hash);
every item is indexed.  Centroids and list statistics have the size of the
lists, at most `MOST_LISTS`, and go to every task.  A long list is dealt out in
parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import identity as V
from tracewell.sources.shared import written

SAMPLE, MOST_LISTS, PART_ROWS, ROUNDS = 20_000, 4096, 20_000, 8
SHELF_ROWS, STEP = 20_000, 256  # items of a shelf; rows that meet all centroids at once
WORN = ["camera_id", "attributes", "colour", "chosen"]  # looks of queries and identities
_ROUNDING = 1e-7  # angles are compared with this much room


@dataclass
class Lists:
    """Centroids, and of each list its radius (largest angle to an item) and number of parts."""

    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the similarity of each query with any item of each list (-inf for an empty list)."""
        angle = np.arccos(np.clip(q @ self.centroids.T, -1, 1))
        return np.where(self.parts > 0, np.cos(np.maximum(angle - self.radius - _ROUNDING, 0)), -np.inf)


@dataclass
class Index:
    """items: list, part, iid, own, embedding; shelves: how many."""

    items: DataFrame
    lists: Lists
    shelves: int = 1


def _fit(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means from seeded rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = np.concatenate([(x[i : i + 1024] @ c.T).argmax(axis=1) for i in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)
    return c


def build(items: DataFrame, lists: int | None = None, own: str | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> Index:
    """Index of items (gid, embedding of length 1); `own` is a whole number column that names a row (see topk)."""
    rows = items.select(F.col("gid").alias("iid"), (F.col(own) if own else F.lit(None)).cast("long").alias("own"), "embedding")
    n = rows.count()
    lists = max(1, min(MOST_LISTS, n // 8 if lists is None else lists))
    # a bounded sample for the centroids alone
    some = rows.orderBy(F.xxhash64("embedding"), "iid").limit(sample).select("embedding").collect()
    if not some:
        return Index(rows.selectExpr("0 AS shelf", "0 AS list", "0 AS part", "*"), Lists(np.zeros((1, 0)), np.zeros(1), np.zeros(1, dtype=np.int64)))
    centroids = _fit(np.array([r[0] for r in some]), lists)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), STEP):
                some = pdf.iloc[i : i + STEP]
                s = np.stack(some["embedding"].to_numpy()) @ centroids.T
                at = s.argmax(axis=1)
                yield pd.DataFrame({"list": at.astype("int32"), "near": s[np.arange(len(s)), at], "iid": some["iid"]})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(near=(np.stack(pdf["embedding"].to_numpy()) * centroids[pdf["list"].to_numpy()]).sum(axis=1))

    kind = rows.schema["iid"].dataType.simpleString()
    homes = rows.mapInPandas(nearest, f"list int, near double, iid {kind}").groupBy(F.col("iid").alias("_i")).agg(F.max(F.struct("near", "list")).alias("h"))
    at_home = rows.join(homes, F.col("iid") == F.col("_i")).select(F.col("h.list").alias("list"), F.lit(0.0).alias("near"), "iid", "own", "embedding")
    placed = written(at_home.mapInPandas(place, f"list int, near double, iid {kind}, own long, embedding array<double>"), "placed")
    # a row per list
    stats = {r["list"]: (r["near"], r["n"]) for r in placed.groupBy("list").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect()}
    radius = np.array([np.arccos(np.clip(stats[i][0], -1, 1)) if i in stats else 0.0 for i in range(len(centroids))])
    size = np.array([stats[i][1] if i in stats else 0 for i in range(len(centroids))], dtype=np.int64)
    parts = -(-size // part_rows)
    # parts of lists in a row, cut where a shelf is full
    each = np.repeat(size / np.maximum(parts, 1), parts)
    shelf = (np.cumsum(each) - each) // SHELF_ROWS
    of, first = np.repeat(np.arange(len(parts)), parts), np.cumsum(parts) - parts
    units = [(int(l), int(u - first[l]), int(parts[l]), int(b)) for u, (l, b) in enumerate(zip(of, shelf, strict=True))]
    units = placed.sparkSession.createDataFrame(units, "_l int, _u int, _n int, shelf int")
    dealt = placed.join(F.broadcast(units.where("_u = 0").select("_l", "_n")), F.col("list") == F.col("_l")).drop("_l")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("iid"), F.col("_n")).cast("int")).drop("_n")
    on = (F.col("list") == F.col("_l")) & (F.col("part") == F.col("_u"))
    dealt = dealt.join(F.broadcast(units), on).select("shelf", "list", "part", "iid", "own", "embedding")
    return Index(dealt, Lists(centroids, radius, parts), int(shelf.max()) + 1 if len(shelf) else 1)


def _named(queries: DataFrame, own: str | None) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("qid"), (F.col(own) if own else F.lit(None)).cast("long").alias("qo"), F.col("embedding").alias("qe"))


def _first_lists(asked: DataFrame, index: Index, first: int) -> DataFrame:
    """`asked` with `near`: the `first` lists of highest bound."""
    lists = index.lists
    if not lists.centroids.shape[1]:
        asked = asked.limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), STEP):
                rows = pdf.iloc[i : i + STEP]
                bounds = lists.bounds(np.stack(rows["qe"].to_numpy()))
                yield rows.assign(near=list(np.argsort(-bounds, axis=1, kind="stable")[:, :first].astype("int32")))

    return asked.mapInPandas(run, "qid long, qo long, qe array<double>, near array<int>")


def _searched(asked: DataFrame, index: Index) -> DataFrame:
    """(list, part, qid): what is searched for queries with their `near` lists and `floor`."""
    lists = index.lists

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), STEP):
                rows = pdf.iloc[i : i + STEP]
                wanted = lists.bounds(np.stack(rows["qe"].to_numpy())) >= rows["floor"].to_numpy()[:, None]
                for j, at in enumerate(rows["near"]):
                    wanted[j, at] = True
                r, c = np.nonzero(wanted & (lists.parts > 0))
                each = lists.parts[c]
                r, c = np.repeat(r, each), np.repeat(c, each)
                part = np.arange(len(c)) - np.repeat(np.cumsum(each) - each, each)
                yield pd.DataFrame({"list": c.astype("int32"), "part": part.astype("int32"), "qid": rows["qid"].to_numpy()[r]})

    return asked.mapInPandas(run, "list int, part int, qid long")


def _meet(asked: DataFrame, index: Index, own: str | None, keep, rest: bool | None = None, worn: tuple[DataFrame, DataFrame] | None = None, schema: str = "query_id long, gid long, score double") -> DataFrame:
    """What keep(queries' ids, identities' ids by item, places, similarities) gives, tile by tile.

    asked: qid, qo, qe, near, floor.  With `rest` None a query meets the lists whose bound reaches its floor;
    if False its `near` ones only, if True those of the former that are not `near`.  Similarities with lists that a
    query doesn't meet are -inf.  With `worn` (looks of queries: id, WORN; of identities: id, WORN) each task gets those of
    its queries and of its identities, and keep gets both tables too.

    Parts of the queries are as large as a task can hold, and more are made only until every core has a task: so an item is
    copied to few tasks.
    """
    lists, dressed = index.lists, worn is not None
    n, shelves = asked.count(), index.shelves
    parts = max(1, -(-n // V.ASK_ROWS), min(-(-n // 1000), -(-asked.sparkSession.sparkContext.defaultParallelism // shelves)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none, nobody = F.lit(None).cast("array<int>"), F.lit(None).cast("double")
    q = asked.select(F.lit(True).alias("query"), F.col("qid").alias("id"), F.col("qo").alias("o"), F.col("qe").alias("e"), "near", "floor", F.lit(-1).alias("list"), F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("b"), every(shelves).alias("shelf"))
    i = index.items.select(F.lit(False).alias("query"), F.col("iid").cast("long").alias("id"), F.col("own").alias("o"), F.col("embedding").alias("e"), none.alias("near"), nobody.alias("floor"), F.col("list").cast("int").alias("list"), every(parts).alias("b"), F.col("shelf").cast("int").alias("shelf"))

    both = q.unionByName(i).withColumn("look", F.lit(False))
    if dressed:
        home = index.items.select(F.col("iid").cast("long").alias("_i"), F.col("shelf").cast("int").alias("shelf")).distinct()
        theirs = worn[1].join(home, F.col("id") == F.col("_i")).withColumn("b", every(parts)).withColumn("query", F.lit(False))
        of_queries = worn[0].withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("shelf", every(shelves)).withColumn("query", F.lit(True))
        for looks in (of_queries, theirs):
            # whole numbers stay whole where no row lacks them
            looks = looks.select("query", "id", "b", "shelf", *WORN, F.lit(0).cast("long").alias("o"), F.lit(-1).alias("list"), F.lit(True).alias("look"))
            both = both.unionByName(looks, allowMissingColumns=True)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        looks: dict[bool, list[pd.DataFrame]] = {True: [], False: []}
        for pdf in batches:
            if dressed:
                for which, r in pdf[pdf["look"]].groupby("query"):
                    looks[bool(which)].append(r[["id", *WORN]])
            for which, r in pdf[~pdf["look"]].groupby("query"):
                more = (r["floor"].to_numpy(), np.array([*r["near"], None], dtype=object)[:-1]) if which else (r["list"].to_numpy(),)
                held[bool(which)].append((r["id"].to_numpy(), r["o"].to_numpy(), np.stack(r["e"].to_numpy()), *more))
        if not held[True] or not held[False]:
            return
        qid, qo, qe, floor, near = (np.concatenate(c) for c in zip(*held[True], strict=True))
        iid, io, ie, of = (np.concatenate(c) for c in zip(*held[False], strict=True))
        by_id = np.argsort(iid, kind="stable")
        places = V.Places(iid[by_id])
        at = by_id[places.order]
        iid, io, ie, of = iid[at], io[at], ie[at], of[at]
        mine = np.unique(of)
        columns = [np.flatnonzero(of == l) for l in mine]
        some = Lists(lists.centroids[mine], lists.radius[mine], lists.parts[mine])
        items = V.Side(iid, iid, io, ie)
        if dressed and not (looks[True] and looks[False]):
            return
        told = [pd.concat(looks[which]).sort_values("id", kind="stable") for which in (True, False)] if dressed else []
        step = max(1, V.TILE // len(iid))
        for a in range(0, len(qid), step):
            z = min(a + step, len(qid))
            first = np.zeros((z - a, len(mine)), dtype=bool)
            if rest is not None:
                for j in range(a, z):
                    first[j - a] = np.isin(mine, near[j])
            wanted = first if rest is False else (some.bounds(qe[a:z]) >= floor[a:z, None]) & ~first
            if not wanted.any():
                continue
            s = np.full((z - a, len(iid)), -np.inf)
            for l in np.flatnonzero(wanted.any(axis=0)):
                r = np.flatnonzero(wanted[:, l])
                s[np.ix_(r, columns[l])] = qe[a + r] @ ie[columns[l]].T
            s[np.isnan(s)] = -np.inf
            if own is not None:
                V.mask_own(s, V.Side(qid[a:z], qid[a:z], qo[a:z], qe[a:z]), items)
            yield from keep(qid[a:z], iid, places, s, *told)

    return both.groupBy("shelf", "b").applyInPandas(score, schema)


def topk(queries: DataFrame, index: Index, k: int, first: int = 2, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, gid, score, rank) as cosine_topk gives them, (list, part, qid) that were searched).

    Each query searches the `first` lists of highest bound, which gives a floor:
    its k-th score so far.  Then it searches those other lists whose bound
    reaches the floor; no other list can hold one of the k best.  An item that is
    named like the query itself (`own`) doesn't count.
    """

    def best(ids, iid, places, s):
        order = np.argsort(iid, kind="stable")
        yield V.best_rows(ids, iid[order], s[:, order], k)

    asked = written(_first_lists(_named(queries, own), index, first), "asked")
    found = written(_meet(asked.withColumn("floor", F.lit(-2.0)), index, own, best, rest=False), "nearest")
    so_far = V.ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
    rows = asked.join(so_far, F.col("qid") == F.col("_q"), "left").select("qid", "qo", "qe", "near", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    rows = written(rows, "floors")
    return V.ranked(found.union(_meet(rows, index, own, best, rest=True)), k), _searched(rows, index)


def identity_scores(queries: DataFrame, anchors: DataFrame, index: Index, least: float, k: int = 3, own: str | None = None) -> DataFrame:
    """(query_id, gid, score) as identity.identity_scores gives them from `least` on, by an index of `anchors`.

    The mean of an identity's best similarities is never above its best one, so lists whose bound is
    below `least` are skipped; an identity's anchors lie in one list, where all are scored.
    """

    def means(ids, iid, places, s):
        yield from V.score_rows(ids, places.ids, places.best_mean(s, k), least)

    asked = _named(queries, own).withColumn("near", F.array().cast("array<int>")).withColumn("floor", F.lit(float(least)))
    return _meet(asked, index, own, means)


def best_matches(
    queries: DataFrame, index: Index, gallery: DataFrame, look: V.Look, threshold: float = 0.42, margin: float = 0.03, bonus: float = 0.12, k: int = 3, own: str | None = None
) -> DataFrame:
    """(query_id, gid, score) as identity.best_matches gives them, by an index of the anchors: a task returns the two best identities of a query.

    queries: query_id (once each), embedding, camera_id, attributes, colour; gallery: gid (once each), camera_id,
    attributes, colour, chosen (recent ones).
    """
    judge = V.match_judge(look, threshold, bonus)
    names = ["query_id", "gid", "score", "same_camera"]
    made: dict[str, tuple] = {}

    def judged(ids, iid, places, s, asks, identities):
        if made.get("of") is not asks:  # once in a task
            cameras, _ = pd.factorize(pd.concat([asks["camera_id"], identities["camera_id"]]))
            asking, gids = (x["id"].to_numpy(dtype=np.int64) for x in (asks, identities))
            # identities in order, of those that have anchors here and a look
            order = np.argsort(places.ids, kind="stable")
            columns = order[np.isin(places.ids[order], gids)]
            at = np.searchsorted(gids, places.ids[columns])
            theirs = V.Looks(identities, cameras[len(asks) :], look).take(at)
            made.update(of=asks, all=(asking, V.Looks(asks, cameras[: len(asks)], look), columns, theirs, identities["chosen"].to_numpy(dtype=float)[at]))
        asking, looks, columns, theirs, recent = made["all"]
        some = np.flatnonzero(np.isin(ids, asking))
        if not len(some) or not len(columns):
            return
        gids, means = places.ids[columns], places.best_mean(s, k)[:, columns]
        out, step = [], max(1, V.LOOKED // len(columns))
        for i in range(0, len(some), step):
            at = some[i : i + step]
            out += judge(ids[at], means[at], looks.take(np.searchsorted(asking, ids[at])), gids, theirs, recent)
        yield pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    kinds = [F.col("camera_id").cast("string").alias("camera_id"), F.col("attributes").cast("array<double>").alias("attributes"), F.col("colour").cast("array<double>").alias("colour")]
    asks = queries.select(F.col("query_id").cast("long").alias("id"), *kinds, F.lit(None).cast("int").alias("chosen"))
    theirs = gallery.select(F.col("gid").cast("long").alias("id"), *kinds, F.col("chosen").cast("int").alias("chosen"))
    asked = _named(queries, own).withColumn("near", F.array().cast("array<int>")).withColumn("floor", F.lit(V.least_similarity(threshold, bonus)))
    found = _meet(asked, index, own, judged, worn=(asks, theirs), schema="query_id long, gid long, score double, same_camera boolean")
    return V.clear_best(found, threshold, margin)
