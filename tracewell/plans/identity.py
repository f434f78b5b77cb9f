"""Queries of identity matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import identity as V
from tracewell.operators import vector_index as N
from tracewell.operators import vision
from tracewell.sources import adapters as X
from tracewell.sources.shared import written

Q, S = {}, {}
HEAD = X.VECTORS_SQL + """,
a AS (SELECT * FROM vec), q AS (SELECT vec_id AS query_id, * FROM vec WHERE vec_id % 20 = 0),
sim AS (SELECT q.query_id, a.gid, a.vec_id, list_dot_product(q.embedding, a.embedding) AS s FROM q, a WHERE a.vec_id <> q.query_id),
top3 AS (SELECT query_id, gid, avg(s) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, gid ORDER BY s DESC) AS n FROM sim) WHERE n <= 3 GROUP BY 1, 2)
"""


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {HEAD} {sql}"
        return f

    return keep


def parts(spark, d):
    """Queries, and all rows as items: a query's own row is told apart by its vec_id."""
    v = X.vectors(spark, d)
    return v.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id")), v


def r6(c):
    return F.bround(c, 6).alias(c)


@query("v1_cosine_topk", "SELECT query_id, gid, round_even(s, 6) AS score, n AS rank FROM (SELECT query_id, vec_id AS gid, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM sim) WHERE n <= 5")
def v1(spark, d):
    q, a = parts(spark, d)
    return V.cosine_topk(q, a.withColumn("gid", F.col("vec_id")), 5, own="vec_id").select("query_id", "gid", r6("score"), "rank")


@query("v2_topk_mean_similarity", "SELECT query_id, gid, round_even(score, 6) AS score FROM top3")
def v2(spark, d):
    return V.identity_scores(*parts(spark, d), own="vec_id").select("query_id", "gid", r6("score"))


@query("v3_fused_score", "SELECT query_id, gid, round_even(CASE WHEN gid % 2 = 0 THEN 0.80::DOUBLE * score + 0.15::DOUBLE * least(1, gid / 50) + 0.05::DOUBLE * 0.5 ELSE 0.70::DOUBLE * score + 0.25::DOUBLE * least(1, gid / 50) + 0.05::DOUBLE * 0.5 END, 6) AS fused FROM top3")
def v3(spark, d):
    s = V.identity_scores(*parts(spark, d), own="vec_id")
    fused = V.fused_score(F.col("score"), F.col("gid") / 50, F.lit(None), F.col("gid") % 2 == 0)
    return s.select("query_id", "gid", F.bround(fused, 6).alias("fused"))


@query(
    "v4_clothing_veto",
    ", n AS (SELECT query_id, vec_id FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10), "
    "p AS (SELECT q.query_id, a.vec_id, list_transform(q.embedding[1:8], lambda x: abs(x)) AS x, list_transform(a.embedding[1:8], lambda x: abs(x)) AS y, (q.query_id % 10) / 10 AS g, (a.vec_id % 10) / 10 AS h FROM n JOIN q USING (query_id) JOIN a ON a.vec_id = n.vec_id) "
    "SELECT query_id, vec_id, abs(g - h) > 0.6 OR (list_max(x) >= 0.25 AND list_max(y) >= 0.25 AND list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) < 0.6) AS veto FROM p",
)
def v4(spark, d):
    q, a = parts(spark, d)
    near = V.cosine_topk(q, a.withColumn("gid", F.col("vec_id")), 10, own="vec_id").select("query_id", F.col("gid").alias("vec_id"))
    p = near.join(q.select("query_id", F.col("embedding").alias("qe")), "query_id").join(a.select("vec_id", "embedding"), "vec_id")
    up = lambda c: F.transform(F.slice(c, 1, 8), F.abs)
    veto = V.clothing_veto((F.col("query_id") % 10) / 10, (F.col("vec_id") % 10) / 10, [(up("qe"), up("embedding"))], strong=0.25, least=0.6)
    return p.select("query_id", "vec_id", veto.alias("veto"))


@query("v6_active_on_camera_guard", "SELECT m.query_id AS track_id, m.camera_id, m.gid FROM q m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.camera_id = m.camera_id AND a.gid = m.gid AND a.ts * 1000000 > 200000000 - 15000000 AND a.vec_id <> m.query_id)")
def v6(spark, d):
    q, a = parts(spark, d)
    held = a.select("camera_id", "gid", F.col("vec_id").alias("track_id"), (F.col("ts") * 1_000_000).alias("ts_us"))
    return V.active_on_camera_guard(q.select(F.col("query_id").alias("track_id"), "camera_id", "gid"), held, 200_000_000)


MEAN = ", e AS (SELECT gid, w, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM w0), s AS (SELECT gid, i, sum(w * x) AS x FROM e GROUP BY 1, 2), n AS (SELECT gid, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) SELECT gid, list(round_even(x / n, 6) + 0.0 ORDER BY i) AS embedding FROM s JOIN n USING (gid) GROUP BY gid"


@query("v7_track_embedding", ", w0 AS (SELECT gid, embedding, greatest(quality / 50, 0.1) AS w FROM vec)" + MEAN)
def v7(spark, d):
    m = V.track_embedding(X.vectors(spark, d).withColumn("sharpness", F.col("quality") / 50), "gid")
    return m.select("gid", F.transform("embedding", lambda x: F.bround(x, 6) + 0.0).alias("embedding"))


@query("v9_prototype", ", w0 AS (SELECT gid, embedding, 1.0::DOUBLE AS w FROM vec QUALIFY row_number() OVER (PARTITION BY gid ORDER BY quality DESC, ts) <= 3)" + MEAN)
def v9(spark, d):
    return V.prototype(X.vectors(spark, d), 3).select("gid", F.transform("embedding", lambda x: F.bround(x, 6) + 0.0).alias("embedding"))


@query("v8_anchor_bank")
def v8(spark, d):
    return V.anchor_bank(X.vectors(spark, d)).select("gid", "ts", "quality")


@query(
    "v10_ema_profile",
    ", r AS (SELECT gid, embedding, row_number() OVER w AS n, count(*) OVER (PARTITION BY gid) AS m FROM vec WINDOW w AS (PARTITION BY gid ORDER BY ts DESC)), "
    "x AS (SELECT gid, CASE WHEN n = m THEN pow(0.95::DOUBLE, n - 1) ELSE 0.05::DOUBLE * pow(0.95::DOUBLE, n - 1) END AS w, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM r), "
    "s AS (SELECT gid, i, sum(w * x) AS x FROM x GROUP BY 1, 2) SELECT gid, list(round_even(x, 6) + 0.0 ORDER BY i) AS profile FROM s GROUP BY gid",
)
def v10(spark, d):
    return V.ema_profile(X.vectors(spark, d)).select("gid", F.transform("profile", lambda x: F.bround(x, 6) + 0.0).alias("profile"))


@query("v10_colour_profile")
def v10_colour(spark, d):
    v = X.vectors(spark, d).withColumn("sharpness", F.col("quality") / 5).withColumn("colour", colour(F.col("embedding")))
    return V.colour_profile(v).select("gid", F.transform("profile", lambda x: F.bround(x, 6) + 0.0).alias("profile"))


def colour(embedding):
    """Eight values that stand for a colour signature."""
    return F.transform(F.slice(embedding, 1, 8), F.abs)


def gallery(spark, d, v=None):
    """An entry per identity: mean of its three best anchors, camera of its first vector, time of its last one."""
    v = X.vectors(spark, d) if v is None else v
    own = v.groupBy("gid").agg(F.min_by("camera_id", "vec_id").alias("camera_id"), (F.max("ts") * 1_000_000).alias("last_us"), F.sum("quality").alias("hits"))
    g = own.join(V.prototype(v, 3).select("gid", F.col("embedding").alias("prototype")), "gid")
    return g.withColumn("assigned", F.col("gid") % 7 == 0).withColumn("colour", colour(F.col("prototype"))).withColumn("attributes", F.lit(None).cast("array<double>"))


GALLERY = (
    ", w0 AS (SELECT gid, embedding FROM vec QUALIFY row_number() OVER (PARTITION BY gid ORDER BY quality DESC, ts) <= 3), "
    "pe AS (SELECT gid, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM w0), ps AS (SELECT gid, i, sum(x) AS x FROM pe GROUP BY 1, 2), pn AS (SELECT gid, sqrt(sum(x * x)) AS n FROM ps GROUP BY 1), "
    "pr AS (SELECT gid, list(x / n ORDER BY i) AS prototype FROM ps JOIN pn USING (gid) GROUP BY gid), "
    "ga AS (SELECT gid, prototype, min_by(camera_id, vec_id) AS camera_id, max(ts) * 1000000 AS last_us, sum(quality) AS hits, gid % 7 = 0 AS assigned, list_transform(prototype[1:8], lambda x: abs(x)) AS colour FROM vec JOIN pr USING (gid) GROUP BY ALL)"
)
NOW = 100_000_000


#: Attributes of the tests: a gender and eight colours.
LOOK = V.Look(0, (tuple(range(1, 9)),), strong=0.25, least=0.6)
LOOKS = (
    GALLERY + ", lk AS (SELECT q.query_id, ga.gid, [(q.query_id % 10) / 10] || list_transform(q.embedding[1:8], lambda x: abs(x)) AS qa, [(ga.gid % 10) / 10] || ga.colour AS ga, list_transform(q.embedding[1:8], lambda x: abs(x)) AS qc, ga.colour AS gc FROM q, ga), "
    "ap AS (SELECT query_id, gid, list_dot_product(qc, gc) AS colour, list_dot_product(qa, ga) / sqrt(list_dot_product(qa, qa) * list_dot_product(ga, ga)) AS attributes, "
    "abs(qa[1] - ga[1]) > 0.6 OR (list_max(qc) >= 0.25 AND list_max(gc) >= 0.25 AND list_dot_product(qc, gc) / sqrt(list_dot_product(qc, qc) * list_dot_product(gc, gc)) < 0.6) AS veto FROM lk)"
)


def looks(df, key):
    """Rows with the attributes and colours that LOOK reads."""
    c = colour(F.col("embedding")) if "embedding" in df.columns else F.col("colour")
    return df.withColumn("colour", c).withColumn("attributes", F.concat(F.array((F.col(key) % 10) / 10), F.col("colour")))


BEST = (
    LOOKS + ", l AS (SELECT query_id, gid, least(1.0, score + CASE WHEN gid % 3 = 0 THEN 0.12 ELSE 0 END) AS e, gid % 2 = 0 AS same, greatest(0, least(1, colour)) AS c, attributes AS t FROM top3 JOIN ap USING (query_id, gid) WHERE NOT veto), "
    "b AS (SELECT query_id, gid, same, CASE WHEN same THEN 0.80::DOUBLE * e + 0.15::DOUBLE * c + 0.05::DOUBLE * t ELSE 0.70::DOUBLE * e + 0.25::DOUBLE * c + 0.05::DOUBLE * t END AS score FROM l), "
    "o AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, gid)) "
    "SELECT query_id, gid, round_even(score, 6) AS score FROM o WHERE n = 1 AND score >= CASE WHEN same THEN 0.42 ELSE 0.44 END AND NOT coalesce(second >= CASE WHEN same THEN 0.42 ELSE 0.44 END AND score - second < 0.03, false)"
)


def matching(spark, d):
    """Queries, asks (one of each query, with its camera and its look), anchors, and the gallery with its looks."""
    q, a = parts(spark, d)
    asks = looks(q, "query_id").select(F.col("query_id").alias("ask_id"), "query_id", "camera_id", "attributes", "colour")
    return q, asks, a, looks(gallery(spark, d), "gid")


def scored(matches):
    return matches.select(F.col("ask_id").alias("query_id"), "gid", r6("score"))


@query("v5_best_match", BEST)
def v5(spark, d):
    q, asks, a, g = matching(spark, d)
    # every second identity counts as one of the query's camera, every third as a recent one
    g = g.withColumn("camera_id", F.when(F.col("gid") % 2 == 0, "own")).withColumn("chosen", F.col("gid") % 3 == 0)
    return scored(V.best_matches(q, asks.withColumn("camera_id", F.lit("own")), a, g, LOOK, own="vec_id"))


@query("v11_drift_reject", "SELECT t.query_id, t.gid, round_even(score, 6) AS score FROM top3 t JOIN q ON q.query_id = t.query_id AND q.gid = t.gid WHERE score >= 0.32")
def v11(spark, d):
    return V.drift_reject(*parts(spark, d), own="vec_id").select("query_id", "gid", r6("score"))


@query("v12_rescue_match", LOOKS + " SELECT query_id, gid, round_even(score, 6) AS score FROM top3 JOIN ap USING (query_id, gid) WHERE NOT veto AND score >= 0.36 AND gid % 4 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) = 1")
def v12(spark, d):
    q, asks, a, g = matching(spark, d)
    return scored(V.rescue_matches(q, asks, a, g.withColumn("chosen", F.col("gid") % 4 == 0), LOOK, own="vec_id"))


@query(
    "v13_closed_world_match",
    LOOKS + ", g AS (SELECT gid, camera_id, last_us FROM ga WHERE gid % 5 <> 0 AND (300000000 - last_us) / 1e6 BETWEEN 5 AND 120), "
    "c AS (SELECT q.query_id, g.gid, count(*) OVER (PARTITION BY q.query_id) AS n FROM q JOIN g ON g.camera_id = q.camera_id JOIN ap ON ap.query_id = q.query_id AND ap.gid = g.gid WHERE NOT veto), "
    "b AS (SELECT * FROM c JOIN top3 USING (query_id, gid) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) = 1) "
    "SELECT query_id, gid, round_even(score, 6) AS score FROM b WHERE score >= CASE WHEN n = 1 THEN 0.15 ELSE 0.25 END",
)
def v13(spark, d):
    q, asks, a, g = matching(spark, d)
    g = g.withColumn("assigned", F.col("gid") % 5 == 0).withColumn("chosen", V.closed_pool(300_000_000))
    return scored(V.closed_world_matches(q, asks, a, g, LOOK, own="vec_id"))


@query(
    "v14_duplicate_pairs",
    GALLERY + ", pool AS (SELECT gid, embedding FROM vec UNION ALL SELECT gid, prototype FROM pr), "
    "sp AS (SELECT x.gid AS a, y.gid AS b, x.vec_id, list_dot_product(x.embedding, y.embedding) AS s FROM vec x JOIN pool y ON x.gid < y.gid), "
    "t AS (SELECT a, b, vec_id, avg(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a, b, vec_id ORDER BY s DESC) AS n FROM sp) WHERE n <= 3 GROUP BY ALL), "
    "u AS (SELECT a, b, avg(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC) AS n FROM t) WHERE n <= 3 GROUP BY 1, 2), "
    "f AS (SELECT u.a, u.b, CASE WHEN x.camera_id = y.camera_id THEN 0.80::DOUBLE * s + 0.15::DOUBLE * greatest(0, least(1, list_dot_product(x.colour, y.colour))) + 0.025::DOUBLE "
    "ELSE 0.70::DOUBLE * s + 0.25::DOUBLE * greatest(0, least(1, list_dot_product(x.colour, y.colour))) + 0.025::DOUBLE END AS score "
    f"FROM u JOIN ga x ON x.gid = u.a JOIN ga y ON y.gid = u.b WHERE NOT (x.assigned AND y.assigned) AND NOT (x.last_us > {NOW} - 12000000 AND y.last_us > {NOW} - 12000000)) "
    "SELECT a, b, round_even(score, 6) AS score FROM f WHERE score >= 0.48",
)
def v14(spark, d):
    return V.duplicate_pairs(*kept(spark, d), NOW).select("a", "b", r6("score"))


def kept(spark, d):
    """Vectors and gallery, which several steps read, written once."""
    v = written(X.vectors(spark, d), "vectors")
    return v, written(gallery(spark, d, v), "gallery")


def merges(spark, d):
    """Duplicates less those whose colours speak against it: the merges they lead to, the gallery and the vectors.

    They are looked for at the moment of the last sighting, so all but the identities of its last seconds are at rest.
    """
    v, g = kept(spark, d)
    last = g.agg(F.coalesce(F.max("last_us"), F.lit(0))).first()[0]
    c = lambda x: g.select(F.col("gid").alias(x), F.col("colour").alias(f"c{x}"))
    pairs = V.duplicate_pairs(v, g, last).join(c("a"), "a").join(c("b"), "b")
    veto = V.clothing_veto(F.lit(0.0), F.lit(0.0), [(F.col("ca"), F.col("cb"))], strong=0.25, least=0.6)
    return written(V.merge_identities(pairs.select("a", "b", "score", veto.alias("veto")), g), "merges"), g, v


@query("v15_merge_identities")
def v15(spark, d):
    return merges(spark, d)[0].select("gid", "kept", F.transform("prototype", lambda x: F.bround(x, 6) + 0.0).alias("prototype"))


@query("v15_merged_gallery")
def v15_gallery(spark, d):
    m, g, v = merges(spark, d)
    g, anchors, tracks = V.merged_gallery(m, g, v, v.select("camera_id", F.col("vec_id").alias("track_id"), "gid"), 6)
    n = anchors.groupBy("gid").agg(F.count("*").alias("anchors"), F.sum("quality").alias("quality"))
    m = tracks.groupBy("gid").agg(F.count("*").alias("tracks"))
    return g.select("gid", "hits").join(n, "gid").join(m, "gid")


SPLIT = (
    ", pq AS (SELECT x.gid, x.ts AS ti, y.ts AS tj FROM vec x JOIN vec y ON x.gid = y.gid AND x.ts < y.ts WHERE list_dot_product(x.embedding, y.embedding) < 0.25), "
    "fp AS (SELECT * FROM pq QUALIFY row_number() OVER (PARTITION BY gid ORDER BY ti, tj) = 1), "
    "sp AS (SELECT v.gid, v.ts, v.embedding, CASE WHEN list_dot_product(v.embedding, b.embedding) > list_dot_product(v.embedding, a.embedding) THEN 1 ELSE 0 END AS part "
    "FROM fp JOIN vec v ON v.gid = fp.gid JOIN vec a ON a.gid = fp.gid AND a.ts = ti JOIN vec b ON b.gid = fp.gid AND b.ts = tj)"
)


@query("v16_split_corrupted", SPLIT + " SELECT gid, ts, CAST(part AS INT) AS part FROM sp")
def v16(spark, d):
    return V.split_corrupted(X.vectors(spark, d))


@query(
    "v16_split_gallery",
    SPLIT + ", nw AS (SELECT gid, (SELECT max(gid) FROM vec) + row_number() OVER (ORDER BY gid) AS new FROM (SELECT DISTINCT gid FROM sp)), "
    "w0 AS (SELECT CASE WHEN part = 1 THEN new ELSE gid END AS gid, embedding, 1.0::DOUBLE AS w FROM sp JOIN nw USING (gid))" + MEAN,
)
def v16_gallery(spark, d):
    v = X.vectors(spark, d)
    _, prototypes = V.split_gallery(v, V.split_corrupted(v))
    return prototypes.select("gid", F.transform("embedding", lambda x: F.bround(x, 6) + 0.0).alias("embedding"))


@query("v17_prune_expired", "SELECT gid, max(ts) * 1000000 AS last_us FROM vec GROUP BY 1 HAVING 500000000 - max(ts) * 1000000 <= 200000000")
def v17(spark, d):
    g = X.vectors(spark, d).groupBy("gid").agg((F.max("ts") * 1_000_000).alias("last_us"))
    return V.prune_expired(g, 500_000_000, 200)


@query("v17_active_gallery_size", "SELECT count(*) AS identities FROM (SELECT gid FROM vec GROUP BY 1 HAVING 500000000 - max(ts) * 1000000 <= 200000000)")
def v17_size(spark, d):
    g = X.vectors(spark, d).groupBy("gid").agg((F.max("ts") * 1_000_000).alias("last_us"))
    return V.active_gallery_size(g, 500_000_000, 200)


def assignment_inputs(spark, d):
    """Every vector takes part: two of an identity's five as a track's rows, the others as the gallery's
    anchors, those of every third identity under a name of a far-off clone that no track resembles."""
    v = X.vectors(spark, d)
    seen = F.col("vec_id") % 5 < 2
    tracks = v.where(seen).select("camera_id", F.col("gid").alias("track_id"), "ts", "embedding", (F.col("quality") / 50).alias("sharpness"), F.col("vec_id").alias("_v"))
    tracks = looks(tracks, "_v").withColumn("attributes", F.when(F.col("_v") % 4 > 0, F.col("attributes"))).drop("_v")
    tracks = tracks.withColumn("camera_id", F.concat(F.lit("camera_"), (F.col("track_id") % 6 + 1).cast("string")))
    flip = F.when(F.col("gid") % 3 == 0, -1.0).otherwise(1.0)
    anchors = v.where(~seen).withColumn("embedding", F.transform("embedding", lambda x: x * flip))
    g = anchors.groupBy("gid").agg(F.min_by("camera_id", "vec_id").alias("camera_id"), (F.max("ts") * 1_000_000).alias("last_us")).withColumn("assigned", F.col("gid") % 7 == 0)
    worn = looks(anchors.groupBy("gid").agg(F.min_by("embedding", "vec_id").alias("embedding")), "gid").select("gid", F.when(F.col("gid") % 5 > 0, F.col("attributes")).alias("attributes"), F.when(F.col("gid") % 6 > 0, F.col("colour")).alias("colour"))
    g = g.join(worn, "gid")
    as_of = 300_000_000
    held = anchors.where("gid % 11 = 0").select("camera_id", "gid", (F.col("gid") + 1).alias("track_id"), F.lit(as_of - 1_000_000).alias("ts_us"))
    return tracks, anchors.select("gid", "embedding"), g, held, g.where("gid % 4 = 0").select("gid"), as_of


@query("v18_assign_identities")
def v18(spark, d):
    return V.assign_identities(*assignment_inputs(spark, d), LOOK)


def detections(spark, d):
    """Boxes crowded into a small frame."""
    t = X.trk(spark, d)
    x, y = F.expr("px div 12"), F.expr("py div 12")
    return t.select("camera_id", F.expr("fast_us div 60000000").alias("frame"), "event_id", x.alias("x1"), y.alias("y1"), (x + 80).alias("x2"), (y + 160).alias("y2"), ((F.col("event_id") % 101) / 101).alias("score"))


@query("v19_nms")
def v19(spark, d):
    return vision.nms(detections(spark, d))


@query("v1_indexed_topk", S["v1_cosine_topk"].partition(f"WITH {HEAD} ")[2])
def v1_indexed(spark, d):
    q, a = parts(spark, d)
    index = N.build(a.withColumn("gid", F.col("vec_id")), own="vec_id")
    return N.topk(q, index, 5, own="vec_id")[0].select("query_id", "gid", r6("score"), "rank")


@query("v5_indexed_match", BEST)
def v5_indexed(spark, d):
    v, g = kept(spark, d)
    q = looks(v.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id")), "query_id").withColumn("camera_id", F.lit("own"))
    # as in v5: every second identity counts as one of the query's camera, every third as a recent one
    g = looks(g, "gid").withColumn("camera_id", F.when(F.col("gid") % 2 == 0, "own")).withColumn("chosen", F.col("gid") % 3 == 0)
    return N.best_matches(q, N.build(v, own="vec_id"), g, LOOK, own="vec_id").select("query_id", "gid", r6("score"))
