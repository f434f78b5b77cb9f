"""Column expressions: persons, zones, points, lines, attributes, poses, questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def person_id(global_id: Name = "global_id", camera: Name = "camera_id", track: Name = "track_id") -> Column:
    """global_id, else camera_track (never empty: null parts leave the underscore)."""
    own = F.when(c(global_id) != "", c(global_id))
    return F.coalesce(own, F.concat(F.coalesce(c(camera), F.lit("")), F.lit("_"), F.coalesce(c(track).cast("string"), F.lit(""))))


def clean_zone(zone: Name = "zone") -> Column:
    """Trimmed zone; empty, unknown, none and null (in any case) become NULL."""
    z = F.trim(c(zone))
    return F.when(~F.lower(z).isin("", "unknown", "none", "null"), z)


def foot_x(x1: Name = "x1", x2: Name = "x2") -> Column:
    return ((c(x1) + c(x2)) / 2).cast("int")


def local_time(ts_ms: Name, tz: str = "UTC") -> Column:
    """Wall-clock timestamp (without zone) of epoch milliseconds; independent of the session's zone."""
    seconds = (c(ts_ms).cast("decimal(20,0)") / 1000).cast("decimal(18,6)")
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return ntz if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), ntz)


def clamp01(x: Name) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(x)))


# ---- lines ------------------------------------------------------------------------


def side_of_line(px: Name, py: Name, x1: Name, y1: Name, x2: Name, y2: Name) -> Column:
    """Signed side of a point; 0 or more counts as inside."""
    return (c(x2) - c(x1)) * (c(py) - c(y1)) - (c(y2) - c(y1)) * (c(px) - c(x1))


def crosses_line(ax: Name, ay: Name, bx: Name, by: Name, x1: Name, y1: Name, x2: Name, y2: Name) -> Column:
    """Whether the segments a-b and 1-2 meet, ends included; parallel ones don't."""
    d = (c(bx) - c(ax)) * (c(y2) - c(y1)) - (c(by) - c(ay)) * (c(x2) - c(x1))
    far = F.abs(d) >= 1e-6
    t = F.when(far, ((c(x1) - c(ax)) * (c(y2) - c(y1)) - (c(y1) - c(ay)) * (c(x2) - c(x1))) / d)
    u = F.when(far, ((c(x1) - c(ax)) * (c(by) - c(ay)) - (c(y1) - c(ay)) * (c(bx) - c(ax))) / d)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def distance_to_line(px: Name, py: Name, x1: Name, y1: Name, x2: Name, y2: Name) -> Column:
    """Distance to the segment."""
    dx, dy = c(x2) - c(x1), c(y2) - c(y1)
    n = (dx * dx + dy * dy).cast("double")
    t = F.when(n == 0, 0.0).otherwise(((c(px) - c(x1)) * dx + (c(py) - c(y1)) * dy) / F.nullif(n, F.lit(0.0)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt((c(px) - c(x1) - t * dx) ** 2 + (c(py) - c(y1) - t * dy) ** 2)


# ---- people -----------------------------------------------------------------------


def decode_attributes(probs: Name, labels: Sequence[str], choices: Mapping[str, Sequence[str | None]], true_only: Sequence[str] = ()) -> Column:
    """Map label -> choice: the positive one above 0.5, else the negative; a NULL choice is
    left out, and labels in `true_only` appear only when positive."""
    pairs = []
    for i, label in enumerate(labels):
        if label not in choices:
            continue
        negative, positive = choices[label]
        p = F.element_at(c(probs), i + 1)
        other = F.lit(None).cast("string") if label in true_only or negative is None else F.lit(negative)
        value = F.when(p > 0.5, F.lit(positive)).otherwise(other)
        pairs.append(F.struct(F.lit(label).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))


def age_category(young: Name, teenager: Name, old: Name, adult: Name, age: Name | None = None) -> Column:
    """Bucket by precedence young, teenager, old, adult, then by the text `age`: old is a senior; nothing known is an adult."""
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    out = F.when(yes(young), "young").when(yes(teenager), "teenager").when(yes(old), "senior").when(yes(adult), "adult")
    if age is not None:
        out = out.when(c(age).isin("young", "child"), "young").when(c(age) == "teenager", "teenager").when(c(age).isin("old", "senior"), "senior")
    return out.otherwise("adult")


#: The joints whose angles are told, each with the points before, at and behind it.
JOINTS = {
    "left_elbow": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow": ("right_shoulder", "right_elbow", "right_wrist"),
    "left_knee": ("left_hip", "left_knee", "left_ankle"),
    "right_knee": ("right_hip", "right_knee", "right_ankle"),
    "left_hip": ("left_shoulder", "left_hip", "left_knee"),
    "right_hip": ("right_shoulder", "right_hip", "right_knee"),
}


def seen_point(points: Name, name: str, least: float) -> Column:
    """A named point of a map<string, struct<x, y, conf>>, NULL below the confidence."""
    p = c(points)[name]
    return F.when(F.coalesce(p["conf"], F.lit(0.0)) >= least, p)


def joint_angle(ax: Name, ay: Name, bx: Name, by: Name, cx: Name, cy: Name) -> Column:
    """Angle at b in degrees, to one decimal; coinciding points make a right angle, NULL ones none."""
    ux, uy, vx, vy = c(ax) - c(bx), c(ay) - c(by), c(cx) - c(bx), c(cy) - c(by)
    n = F.sqrt((ux * ux + uy * uy).cast("double")) * F.sqrt((vx * vx + vy * vy).cast("double"))
    cos = (ux * vx + uy * vy) / (n + F.lit(1e-6))
    known = n.isNotNull()  # least and greatest would skip NULL
    return F.when(known, F.bround(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), 1))


def angle_of(points: Name, joint: str, least: float = 0.5) -> Column:
    """Angle of one of JOINTS, NULL unless its three points are seen with the confidence."""
    a, b, z = (seen_point(points, n, least) for n in JOINTS[joint])
    return joint_angle(a["x"], a["y"], b["x"], b["y"], z["x"], z["y"])


def joint_angles(points: Name, least: float = 0.5) -> Column:
    """Map of the six joint angles whose three points are all seen with the confidence.

    Who wants columns takes `angle_of` each: entries taken from the map would make the whole map once per entry.
    """
    pairs = [F.struct(F.lit(joint).alias("key"), angle_of(points, joint, least).alias("value")) for joint in JOINTS]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def posture(hip_y: Name, knee_y: Name, sitting: float = 0.2, crouching: float = 0.45) -> Column:
    """From how far the knees lie below the hips, relative to the hips' height; NULL points: unknown."""
    ratio = (c(knee_y) - c(hip_y)).cast("double") / F.greatest(c(hip_y).cast("double"), F.lit(0.01))
    known = c(knee_y).isNotNull() & c(hip_y).isNotNull()
    return F.when(~known, "unknown").when(ratio < sitting, "sitting").when(ratio < crouching, "crouching").otherwise("standing")


def posture_of(points: Name, least: float = 0.5) -> Column:
    """Posture from both hips and both knees of a keypoint map."""
    mid = lambda part: (seen_point(points, f"left_{part}", least)["y"] + seen_point(points, f"right_{part}", least)["y"]) / 2
    return posture(mid("hip"), mid("knee"))


def fire_smoke(fire: Name, smoke: Name, fire_least: float = 0.003, smoke_least: float = 0.04) -> Column:
    """fire, else smoke, else NULL, from ratios of a frame."""
    return F.when(c(fire) >= fire_least, "fire").when(c(smoke) >= smoke_least, "smoke")
