"""SQL of queries whose next row depends on the last decision, and of those that gather other queries.

A fold is a recursive table expression: one step a row of every key, or one step a kept row.
"""

from __future__ import annotations

from tracewell.functions.questions import DATA, TEMPORAL, TRAIL, VISUAL
from tracewell.operators.alerts import COOLDOWNS
from tracewell.plans import alerts, fleet, joins, sequences, traffic
from tracewell.sources import adapters as X

Q, S = {}, {}


def spaced(rows: str, keys: str, columns: str) -> str:
    """Rows at least `gap` after the last kept one of their key, of rows with keys, ts, n (1, 2, ... in order) and gap."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return (
        f"WITH RECURSIVE {X.SQL}, c AS MATERIALIZED ({rows}), f AS (SELECT {keys}, ts, min(n) AS n FROM c GROUP BY ALL), "
        f"p AS MATERIALIZED (SELECT a.*, b.n AS next FROM c a ASOF LEFT JOIN f b ON {same} AND a.ts + a.gap <= b.ts), "
        f"kept AS (SELECT * FROM p WHERE n = 1 UNION ALL SELECT b.* FROM kept a JOIN p b ON {same} AND b.n = a.next) SELECT {columns} FROM kept"
    )


S["w10_throttle"] = spaced(
    "SELECT camera_id, fast_us AS ts, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY fast_us, event_id) AS n, 1000000 AS gap FROM trk", "camera_id", "camera_id, ts AS fast_us, event_id"
)


def cooldown(candidates: list[str], keys: str) -> str:
    gap = " ".join(f"WHEN '{k}' THEN {int(v * 1e6)}" for k, v in COOLDOWNS.items())
    union = " UNION ALL ".join(f"SELECT {keys}, ts_us AS ts, camera_id FROM ({sql})" for sql in candidates)
    ticks = f"SELECT {keys}, ts, min(camera_id) AS camera_id FROM ({union}) GROUP BY ALL"
    rows = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS n, CASE type {gap} END AS gap FROM ({ticks})"
    return spaced(rows, keys, f"{keys}, ts AS ts_us, camera_id")


S["al7_apply_cooldown"] = cooldown([alerts.S[k] for k in ("al1_queue_alerts", "al3_dwell_alerts", "al5_surge_alerts")], "type, entity")
S["al7_fleet_cooldown"] = cooldown([fleet.S[k] for k in ("al1_fleet_queues", "al3_fleet_dwell", "al5_fleet_surges")], "store_id, type, entity")

#: last: time of the last crossing that counted.
S["w2_gated_crossings"] = (
    f"WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id) AS n FROM ({sequences.S['w2_line_crossings']})), "
    "s AS (SELECT *, true AS counts, ts_us AS last FROM c WHERE n = 1 "
    "UNION ALL SELECT c.*, c.kind = 'entry' OR c.ts_us - s.last >= 8000000, CASE WHEN c.kind = 'entry' OR c.ts_us - s.last >= 8000000 THEN c.ts_us ELSE s.last END "
    "FROM s JOIN c ON c.camera_id = s.camera_id AND c.track_id = s.track_id AND c.n = s.n + 1) SELECT camera_id, track_id, ts_us, event_id, kind FROM s WHERE counts"
)
#: All rows arrive in one batch, so no state times out between them.
S["t4_stream_crossings"] = S["w2_gated_crossings"]

S["w3_smooth_positions"] = (
    f"WITH RECURSIVE {X.SQL}, c AS MATERIALIZED (SELECT camera_id, track_id, fast_us AS ts_us, event_id, CAST((x1 + x2) // 2 AS BIGINT) AS fx, y2, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id) AS n FROM tr), "
    "s AS (SELECT *, fx::DOUBLE AS a, y2::DOUBLE AS b FROM c WHERE n = 1 "
    "UNION ALL SELECT c.*, 0.65::DOUBLE * s.a + 0.35::DOUBLE * c.fx, 0.65::DOUBLE * s.b + 0.35::DOUBLE * c.y2 FROM s JOIN c ON c.camera_id = s.camera_id AND c.track_id = s.track_id AND c.n = s.n + 1) "
    "SELECT camera_id, track_id, ts_us, event_id, fx, y2, CAST(trunc(a) AS INT) AS fx_smooth, CAST(trunc(b) AS INT) AS y2_smooth FROM s"
)

S["al10_lockouts"] = (
    f"WITH RECURSIVE {X.SQL}, r AS MATERIALIZED (SELECT '10.0.0.' || track_id AS ip, fast_us AS ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY track_id ORDER BY fast_us, event_id) AS n FROM trk), "
    "s AS (SELECT DISTINCT ip, 0::BIGINT AS n, 0::BIGINT AS ts, []::BIGINT[] AS fails, -1::BIGINT AS until, false AS locks FROM r "
    "UNION ALL SELECT ip, n, ts, CASE WHEN idle THEN fails WHEN ok OR len(more) >= 5 THEN [] ELSE more END, CASE WHEN NOT idle AND NOT ok AND len(more) >= 5 THEN ts + 900000000 ELSE until END, NOT idle AND NOT ok AND len(more) >= 5 "
    "FROM (SELECT r.*, s.fails, s.until, r.ts < s.until AS idle, list_append(list_filter(s.fails, lambda t: r.ts - t <= 300000000), r.ts) AS more FROM s JOIN r ON r.ip = s.ip AND r.n = s.n + 1)) "
    "SELECT ip, ts AS from_us, until AS to_us FROM s WHERE locks"
)

#: `rest`: boxes of a frame, best first, that no kept box covers; its first one is kept next.
S["v19_nms"] = (
    f"WITH RECURSIVE {X.SQL}, b AS (SELECT camera_id, fast_us // 60000000 AS frame, event_id, CAST(px // 12 AS BIGINT) AS x1, CAST(py // 12 AS BIGINT) AS y1, CAST(px // 12 + 80 AS BIGINT) AS x2, CAST(py // 12 + 160 AS BIGINT) AS y2, (event_id % 101) / 101 AS score FROM trk), "
    "s AS (SELECT camera_id, frame, list({'event_id': event_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score} ORDER BY score DESC, event_id) AS rest FROM b GROUP BY ALL "
    "UNION ALL SELECT camera_id, frame, list_filter(rest[2:], lambda o: "
    "greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0) <= 0.45::DOUBLE * "
    "((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0))) "
    "FROM (SELECT *, rest[1] AS k FROM s) WHERE len(rest) > 0) "
    "SELECT camera_id, frame, unnest(rest[1]) FROM s WHERE len(rest) > 0"
)


#: `reach`: whom each person is linked to over lasting pairs, themselves included.
S["j6_groups"] = (
    f"WITH RECURSIVE l AS MATERIALIZED ({joins.S['j6_lasting_pairs']}), both_ways AS MATERIALIZED (SELECT snap, a, b FROM l UNION SELECT snap, b, a FROM l), "
    "reach AS (SELECT snap, a, a AS b FROM both_ways UNION SELECT r.snap, r.a, w.b FROM reach r JOIN both_ways w ON r.snap = w.snap AND r.b = w.a), "
    'g AS (SELECT snap, a, min(b) AS "group" FROM reach GROUP BY ALL) SELECT snap, "group", CAST(count(*) AS INT) AS size, list(a ORDER BY a) AS members FROM g GROUP BY snap, "group"'
)

#: old: segments that may be taken up; held: the last instant at which each id is in use.
STITCHED = (
    f"WITH RECURSIVE {X.SQL} {joins.SEG}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY start_us, seg) AS n FROM seg), "
    "s AS (SELECT DISTINCT camera_id, 0::BIGINT AS n, 0::BIGINT AS seg, 0::BIGINT AS root, NULL::BIGINT AS old_id, []::STRUCT(seg BIGINT, ends BIGINT, x BIGINT, y BIGINT, root BIGINT)[] AS old, []::STRUCT(root BIGINT, ends BIGINT)[] AS held FROM r "
    "UNION ALL SELECT camera_id, n, seg, own, found.seg, list_append(old, {'seg': seg, 'ends': end_us, 'x': ex, 'y': ey, 'root': own}), "
    "list_append(list_filter(held, lambda h: h.root <> own), {'root': own, 'ends': greatest(coalesce(list_filter(held, lambda h: h.root = own)[1].ends, end_us), end_us)}) "
    "FROM (SELECT *, coalesce(found.root, seg) AS own FROM ("
    "SELECT *, list_filter(old, lambda o: start_us - o.ends > 500000 AND (sx - o.x) ** 2 + (sy - o.y) ** 2 < 500 * 500 AND NOT list_contains(list_transform(list_filter(held, lambda h: h.ends >= start_us), lambda h: h.root), o.root))[1] AS found FROM ("
    "SELECT * REPLACE (list_filter(held, lambda h: h.ends >= start_us OR list_contains(list_transform(old, lambda o: o.root), h.root)) AS held) FROM ("
    "SELECT r.*, list_filter(s.old, lambda o: r.start_us - o.ends < 5000000) AS old, s.held FROM s JOIN r ON r.camera_id = s.camera_id AND r.n = s.n + 1))))) "
)
S["j3_stitch_tracks"] = STITCHED + "SELECT seg, old_id, root FROM s WHERE old_id IS NOT NULL"
S["j3_inherited_entries"] = (
    STITCHED + ", t AS (SELECT seg.seg, start_us, coalesce(s.root, seg.seg) AS track, seg.seg % 5 = 0 AS own FROM seg JOIN (SELECT * FROM s WHERE n > 0) s USING (camera_id, seg)) "
    "SELECT seg, track, bool_or(own) OVER (PARTITION BY track ORDER BY start_us, seg) AS has_entered FROM t"
)

#: Five vectors an identity never fill a bank, so none is swapped here.
S["v8_anchor_bank"] = (
    f"WITH RECURSIVE {X.VECTORS_SQL}, r AS MATERIALIZED (SELECT gid, ts, quality, embedding, row_number() OVER (PARTITION BY gid ORDER BY ts) AS n, count(*) OVER (PARTITION BY gid) AS most FROM vec), "
    "s AS (SELECT gid, n, most, [{'ts': ts, 'quality': quality, 'v': embedding}] AS bank FROM r WHERE n = 1 "
    "UNION ALL SELECT r.gid, r.n, r.most, CASE WHEN list_max(list_transform(s.bank, lambda b: list_dot_product(b.v, r.embedding))) >= 0.72 THEN s.bank ELSE list_append(s.bank, {'ts': r.ts, 'quality': r.quality, 'v': r.embedding}) END "
    "FROM s JOIN r ON r.gid = s.gid AND r.n = s.n + 1) SELECT gid, b.ts AS ts, b.quality AS quality FROM (SELECT gid, unnest(bank) AS b FROM s WHERE n = most)"
)

NORM = "sqrt(list_sum(list_transform(m, lambda x: x * x)))"
S["v10_colour_profile"] = (
    f"WITH RECURSIVE {X.VECTORS_SQL}, r AS MATERIALIZED (SELECT gid, list_transform(embedding[1:8], lambda x: abs(x)) AS c, row_number() OVER (PARTITION BY gid ORDER BY ts) AS n, count(*) OVER (PARTITION BY gid) AS most FROM vec WHERE quality / 5 > 8), "
    "s AS (SELECT gid, n, most, c AS p FROM r WHERE n = 1 "
    f"UNION ALL SELECT gid, n, most, CASE WHEN {NORM} > 1e-8 THEN list_transform(m, lambda x: x / {NORM}) ELSE m END FROM "
    "(SELECT r.gid, r.n, r.most, list_transform(list_zip(s.p, r.c), lambda z: 0.8::DOUBLE * z[1] + 0.2::DOUBLE * z[2]) AS m FROM s JOIN r ON r.gid = s.gid AND r.n = s.n + 1)) "
    "SELECT gid, list_transform(p, lambda x: round_even(x, 6) + 0.0) AS profile FROM s WHERE n = most"
)


def reflected(size: int, name: str) -> str:
    """(cell, source, w): what each cell of an axis takes from others; beyond the edge the axis is mirrored."""
    sigma = 0.3 * ((25 - 1) * 0.5 - 1) + 0.8
    w = f"exp(-(o * o) / {2 * sigma**2}::DOUBLE)"
    return (
        f"{name} AS MATERIALIZED (SELECT cell, CASE WHEN cell + o < 0 THEN -(cell + o) WHEN cell + o >= {size} THEN {2 * size - 2} - (cell + o) ELSE cell + o END AS source, "
        f"{w} / sum({w}) OVER (PARTITION BY cell) AS w FROM range({size}) a(cell), range(-12, 13) b(o))"
    )


S["a13_smooth_density"] = (
    f"WITH {X.SQL}, {reflected(180, 'ty')}, {reflected(320, 'tx')}, "
    "g AS (SELECT camera_id, CAST(least(trunc(cx * 320), 319) AS INT) AS x, CAST(least(trunc(cy * 180), 179) AS INT) AS y, count(*) AS n FROM positions GROUP BY ALL), "
    "v AS (SELECT camera_id, x, ty.cell AS y, sum(n * w) AS n FROM g JOIN ty ON y = source GROUP BY ALL), "
    "h AS (SELECT camera_id, tx.cell AS x, y, sum(n * w) AS n FROM v JOIN tx ON x = source GROUP BY ALL), "
    "s AS (SELECT camera_id, x, y, floor(n / max(n) OVER (PARTITION BY camera_id) * 255) AS value FROM h) "
    "SELECT camera_id, CAST(x AS INT) AS bx, CAST(y AS INT) AS by, CAST(value AS INT) AS value, CASE WHEN value < 3 THEN 0 ELSE CAST(trunc(value * 0.85::DOUBLE) AS INT) END AS alpha FROM s WHERE value > 0"
)

WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
BEFORE, AFTER, DIGIT, SPACE = f"(?:^|[^{WORD}])", f"(?:$|[^{WORD}])", r"\p{Nd}", r"[\s\p{Z}]"


def found(patterns: list[str]) -> str:
    """A search whose words and boundaries are those of Unicode, for an engine whose \\b knows ASCII only."""
    one = lambda p: BEFORE + p.replace(r"\b|", "|").removeprefix(r"\b").removesuffix(r"\b").replace(r"\d", DIGIT).replace(r"\s", SPACE) + AFTER
    return f"regexp_matches(low, '{'|'.join(one(p) for p in patterns)}')"


S["p18_classify_questions"] = (
    "WITH t AS (SELECT conv_id AS session, turn AS seq, lower(CASE turn % 5 WHEN 0 THEN 'How many people came today? ' WHEN 1 THEN 'Where has person 42 been ' WHEN 2 THEN 'what is happening at cam 3 ' WHEN 3 THEN 'show me the Till ' ELSE '' END || coalesce(text, '')) AS low FROM conversations), "
    f"n AS (SELECT *, regexp_extract(low, '{BEFORE}cam(?:era|[aâ]ra|)[\\s\\p{{Z}}_-]?({DIGIT}+){AFTER}', 1) AS cam, regexp_extract(low, '{BEFORE}(?:person|pessoa|id|gid|track|individual)[\\s\\p{{Z}}#_\\-]?({DIGIT}+){AFTER}', 1) AS person FROM t), "
    "r AS (SELECT session, seq, CASE WHEN cam <> '' THEN 'camera_' || cam WHEN contains(low, 'entrance') OR contains(low, 'door') THEN 'camera_1' WHEN contains(low, 'till') OR contains(low, 'checkout') THEN 'camera_2' END AS camera_id, nullif(person, '') AS person_id, "
    f"{found(DATA + TEMPORAL)} AS is_data, {found(VISUAL)} AS is_visual, {found(TEMPORAL)} AS is_temporal, person <> '' AND {found(TRAIL)} AS is_trail FROM n) "
    "SELECT *, CASE WHEN is_trail THEN 'trail' WHEN is_temporal THEN 'historical' WHEN person_id IS NOT NULL THEN 'person' WHEN camera_id IS NOT NULL THEN 'scene' ELSE 'store' END AS type, is_visual OR NOT is_data AS needs_vlm FROM r"
)


def _one(name: str) -> str:
    return f"(SELECT q FROM ({traffic.S[name]}) q)"


def _all(name: str) -> str:
    return f"(SELECT coalesce(list(q ORDER BY q), []) FROM ({traffic.S[name]}) q)"


S["a21_dashboard"] = (
    f"SELECT {_one('a11_compare_days')} AS days, {_one('a3_peak_hour')} AS peak, {_one('a6_top_zone')} AS top_zone, {_all('a2_hourly_traffic')} AS hours, "
    f"{_all('a6_zone_totals')} AS zones, {_all('a7_dwell_by_zone')} AS dwell, {_all('a8_gender_split')} AS gender, {_all('a8_age_split')} AS age"
)
