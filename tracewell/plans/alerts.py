"""Queries of events, alerts and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import questions
from tracewell.operators import alerts as E
from tracewell.operators import gates as G
from tracewell.plans import traffic as base
from tracewell.plans.sequences import STOPS
from tracewell.sources import adapters as X

AS_OF = base.AS_OF
Q, S = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {X.SQL} {sql}"
        return f

    return keep


@query("e1_list_events", "SELECT * FROM flagged WHERE camera_id = 'camera_2' AND reviewed = 1 ORDER BY ts DESC, id DESC LIMIT 100")
def e1(spark, d):
    return E.list_events(X.flagged_events(spark, d), "camera_2", True)


CHANGES = ", ch AS (SELECT CAST(event_id // 5 AS VARCHAR) AS id, CASE event_id % 5 WHEN 0 THEN 'flag' WHEN 3 THEN 'review' ELSE 'x' END AS op, event_id AS seq, us // 1000 AS ts, camera_id FROM trk WHERE event_id % 5 IN (0, 3)), del AS (SELECT CAST(event_id // 5 AS VARCHAR) AS id FROM trk WHERE event_id % 35 = 4)"


def changes(spark, d):
    t = X.trk(spark, d).withColumn("m", F.col("event_id") % 5)
    op = F.when(F.col("m") == 0, "flag").when(F.col("m") == 3, "review").when(F.col("event_id") % 35 == 4, "delete")
    return t.withColumn("op", op).where("op is not null").select("op", F.col("event_id").alias("seq"), F.expr("cast(event_id div 5 as string)").alias("id"), F.expr("us div 1000").alias("ts"), "camera_id", F.lit(0).alias("reviewed"))


@query("e2_event_state", CHANGES + " SELECT id, min(ts) FILTER (op = 'flag') AS ts, min(camera_id) FILTER (op = 'flag') AS camera_id, CAST(max(CASE WHEN op = 'review' THEN 1 ELSE 0 END) AS INT) AS reviewed FROM ch WHERE id NOT IN (SELECT id FROM del) GROUP BY id")
def e2(spark, d):
    return E.event_state(changes(spark, d))


@query(
    "e3_merge_events",
    CHANGES + ", b AS (SELECT id, ts, camera_id, 0 AS reviewed FROM ch WHERE op = 'flag' AND CAST(id AS BIGINT) % 2 = 0), c AS (SELECT * FROM ch WHERE NOT (op = 'flag' AND CAST(id AS BIGINT) % 2 = 0)) "
    "SELECT id, ts, camera_id, CASE WHEN id IN (SELECT id FROM c WHERE op = 'review') THEN 1 ELSE 0 END AS reviewed FROM (SELECT id, ts, camera_id FROM b UNION ALL SELECT id, ts, camera_id FROM c WHERE op = 'flag') WHERE id NOT IN (SELECT id FROM del)",
)
def e3(spark, d):
    c = changes(spark, d)
    even = (F.col("op") == "flag") & (F.col("id").cast("long") % 2 == 0)
    return E.merge_events(c.where(even).select("id", "ts", "camera_id", "reviewed"), c.where(~even))


@query("e4_recent_alerts", "SELECT id, ts, camera_id FROM flagged ORDER BY ts DESC, id DESC LIMIT 50")
def e4(spark, d):
    return E.recent_alerts(X.flagged_events(spark, d)).select("id", "ts", "camera_id")


@query("e4_dismiss", "SELECT id, reviewed = 1 AS dismissed FROM flagged")
def e4b(spark, d):
    a = X.flagged_events(spark, d)
    return E.dismiss(a.select("id", F.lit(False).alias("dismissed")), a.where("reviewed = 1"))


PRESENT = (
    ", c AS (SELECT person, camera_id, fast_us, event_id, unnest(generate_series((fast_us + 4999999) // 5000000, (fast_us + 11999999) // 5000000)) AS tick FROM tr), "
    "p AS (SELECT tick, person, arg_max(camera_id, event_id) AS camera_id FROM c WHERE tick * 5000000 - fast_us < 12000000 GROUP BY 1, 2)"
)


@query("al1_queue_alerts", PRESENT + " SELECT 'queue' AS type, '' AS entity, tick * 5000000 AS ts_us, camera_id, count(*) AS value FROM p GROUP BY tick, camera_id HAVING count(*) >= 6")
def al1(spark, d):
    return E.queue_alerts(X.tracking(spark, d, "fast_us"))


@query("al2_capacity_alerts", PRESENT + " SELECT 'capacity' AS type, '' AS entity, tick * 5000000 AS ts_us, '' AS camera_id, count(*) AS value FROM p GROUP BY tick HAVING count(*) >= 25")
def al2(spark, d):
    return E.capacity_alerts(X.tracking(spark, d, "fast_us"), 25)


def dwell_sql(kind: str, minutes: int, entity: str) -> str:
    return STOPS + (
        ", x AS (SELECT person, camera_id, fast_us, min(fast_us) OVER (PARTITION BY person, stop) AS entry_us, "
        "least(coalesce(lead(fast_us) OVER (PARTITION BY person ORDER BY fast_us, event_id) - 1, fast_us + 11999999), fast_us + 11999999) AS until FROM i), "
        f"t AS (SELECT *, unnest(generate_series((greatest(fast_us, entry_us + {minutes * 60_000_000}) + 4999999) // 5000000, until // 5000000)) AS tick FROM x) "
        f"SELECT '{kind}' AS type, {entity} AS entity, tick * 5000000 AS ts_us, camera_id, (tick * 5000000 - entry_us) // 60000000 AS value FROM t"
    )


@query("al3_dwell_alerts", dwell_sql("dwell", 5, "person"))
def al3(spark, d):
    return E.dwell_alerts(X.tracking(spark, d, "fast_us"))


@query("al4_loitering_alerts", dwell_sql("loitering", 10, "'loiter_' || person"))
def al4(spark, d):
    return E.loitering_alerts(X.tracking(spark, d, "fast_us"))


@query("al5_surge_alerts", ", s AS (SELECT unnest(generate_series((fast_us + 4999999) // 5000000, (fast_us + 4999999) // 5000000 + 23)) AS tick FROM occ WHERE event_type = 'entry') SELECT 'surge' AS type, '' AS entity, tick * 5000000 AS ts_us, '' AS camera_id, count(*) AS value FROM s GROUP BY tick HAVING count(*) >= 12")
def al5(spark, d):
    return E.surge_alerts(X.occupancy_log(spark, d, "fast_us"))


@query("al6_offline_alerts", f"SELECT 'camera_offline' AS type, 'offline_' || camera_id AS entity, {AS_OF} AS ts_us, camera_id, ({AS_OF} - max(fast_us)) // 1000000 AS value FROM trk WHERE fast_us <= {AS_OF} AND camera_id <> 'camera_3' GROUP BY camera_id HAVING {AS_OF} - max(fast_us) > 2000000")
def al6(spark, d):
    pings = X.trk(spark, d).select("camera_id", F.col("fast_us").alias("ts_us")).where(F.col("ts_us") <= AS_OF)
    return E.offline_alerts(base.cameras(spark, d), pings, AS_OF, 2)


@query("al7_apply_cooldown")
def al7(spark, d):
    t = X.tracking(spark, d, "fast_us")
    both = E.queue_alerts(t).unionByName(E.dwell_alerts(t)).unionByName(E.surge_alerts(X.occupancy_log(spark, d, "fast_us")))
    return G.apply_cooldown(both.drop("value"), E.COOLDOWNS)


@query("al8_quiet_hours", "SELECT event_id, us AS ts_us FROM trk WHERE NOT ((us // 60000000) % 1440 >= 1320 OR (us // 60000000) % 1440 < 390)")
def al8(spark, d):
    return E.quiet_hours(X.trk(spark, d).select("event_id", F.col("us").alias("ts_us")), "22:00", "06:30")


@query("al10_lockouts")
def al10(spark, d):
    return G.lockouts(X.attempts(spark, d))


@query("p18_classify_questions")
def p18(spark, d):
    n = F.col("seq") % 5
    head = F.when(n == 0, "How many people came today? ").when(n == 1, "Where has person 42 been ").when(n == 2, "what is happening at cam 3 ").when(n == 3, "show me the Till ").otherwise("")
    chat = X.chat(spark, d).withColumn("q", F.concat(head, F.coalesce("text", F.lit(""))))
    cams = spark.createDataFrame([(0, "camera_1", ["Entrance", "door"]), (1, "camera_2", ["Till", "checkout"])], "idx int, camera_id string, names array<string>")
    return questions.classify_questions(chat.select("session", "seq", "q"), "q", cams).drop("q")
