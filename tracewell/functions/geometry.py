"""Zones, world coordinates and homographies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.shared import join_dimension


def _edges(vertices: Column) -> Column:
    turned = F.concat(F.slice(vertices, F.lit(2), F.size(vertices) - 1), F.slice(vertices, 1, 1))
    return F.zip_with(vertices, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def inside_polygon(px: Column, py: Column, vertices: Column) -> Column:
    """Whether the point lies inside or on an edge; fewer than three vertices hold nothing."""
    edges = _edges(vertices)

    def on(e):
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        between = px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (cross == 0) & between

    def ray(e):
        at = F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), (e["y2"] - e["y1"]).cast("double")) + e["x1"]
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < at)

    odd = F.size(F.filter(edges, ray)) % 2 == 1
    return (F.size(vertices) >= 3) & (F.exists(edges, on) | odd)


def find_zone(df: DataFrame, zones: DataFrame, px: str = "px", py: str = "py", unknown: str = "Unknown") -> DataFrame:
    """Add zone: the first polygon of the row's camera (in configuration order) that holds the point.

    zones: camera_id, zone_idx, zone, vertices.  A camera's zones travel as one
    array, so no row is multiplied.
    """
    lists = zones.groupBy(F.col("camera_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("zone_idx", "zone", "vertices"))).alias("_zones"))
    x, y = F.col(px), F.col(py)
    hit = F.filter("_zones", lambda z: inside_polygon(x, y, z["vertices"]))
    joined = join_dimension(df, lists, "camera_id", "_c")
    return joined.withColumn("zone", F.coalesce(F.try_element_at(hit, F.lit(1))["zone"], F.lit(unknown))).drop("_c", "_zones")


def _touches(e: Column, x0: Column, y0: Column, size: int) -> Column:
    """Whether an edge meets the closed square at (x0, y0): boxes overlap, and its line has corners on both sides."""
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    corners = [side(x, y).cast("double") for x in (x0, x0 + size) for y in (y0, y0 + size)]
    apart = (F.greatest(e["x1"], e["x2"]) < x0) | (F.least(e["x1"], e["x2"]) > x0 + size) | (F.greatest(e["y1"], e["y2"]) < y0) | (F.least(e["y1"], e["y2"]) > y0 + size)
    return ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def zone_cells(zones: DataFrame, cell: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Index of zones: (by, camera_id, gx, gy, candidates), a row per square of `cell` pixels that a polygon meets.

    candidates: the polygons that meet the square, in configuration order, up to
    the first that holds it whole (`whole`, which then needs no test).  Made in
    Spark: a polygon's squares are those of its bounding box, and an edge that
    meets none of a square leaves it wholly inside or outside.
    """
    keys = [*by, "camera_id"]
    z = zones.where(F.size("vertices") >= 3).select(*keys, "zone_idx", "zone", "vertices")
    span = lambda c: F.sequence(F.floor(F.array_min(F.transform("vertices", lambda p: p[c])) / cell).cast("int"), F.floor(F.array_max(F.transform("vertices", lambda p: p[c])) / cell).cast("int"))
    z = z.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    x0, y0 = F.col("gx") * cell, F.col("gy") * cell
    z = z.withColumn("border", F.exists(_edges(F.col("vertices")), lambda e: _touches(e, x0, y0, cell)))
    z = z.where(F.col("border") | inside_polygon(x0 + cell / 2, y0 + cell / 2, F.col("vertices")))
    one = F.struct("zone_idx", (~F.col("border")).alias("whole"), "zone", F.when(F.col("border"), F.col("vertices")).alias("vertices"))
    lists = z.groupBy(*keys, "gx", "gy").agg(F.array_sort(F.collect_list(one)).alias("c"))
    first = F.array_position(F.transform("c", lambda x: x["whole"]), True).cast("int")
    return lists.select(*keys, "gx", "gy", F.when(first > 0, F.slice("c", 1, first)).otherwise(F.col("c")).alias("candidates"))


def find_zone_by_cell(df: DataFrame, cells: DataFrame, px: str = "px", py: str = "py", unknown: str = "Unknown", cell: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """As find_zone, with the index of zone_cells: a row is tested against the polygons at its square only.

    Adds zone, and zone_tests: the polygons that the row was tested against.
    """
    x, y = F.col(px), F.col(py)
    square = F.struct(*by, "camera_id", F.floor(x / cell).cast("int").alias("gx"), F.floor(y / cell).cast("int").alias("gy"))
    own = cells.select(F.struct(*by, "camera_id", "gx", "gy").alias("_own"), "candidates")
    joined = join_dimension(df.withColumn("_square", square), own, "_square", "_own")
    hit = F.filter("candidates", lambda z: z["whole"] | F.coalesce(inside_polygon(x, y, z["vertices"]), F.lit(False)))
    tests = F.coalesce(F.size(F.filter("candidates", lambda z: ~z["whole"])), F.lit(0))
    zone = F.coalesce(F.try_element_at(hit, F.lit(1))["zone"], F.lit(unknown))
    return joined.withColumn("zone", zone).withColumn("zone_tests", F.greatest(tests, F.lit(0))).drop("_own", "_square", "candidates")


def normalise_zones(zones: DataFrame, width: int, height: int) -> DataFrame:
    """Vertices as shares of the frame, to four decimals; polygons below three points go."""
    share = F.transform("vertices", lambda p: F.struct(F.bround(p["x"] / width, 4).alias("x"), F.bround(p["y"] / height, 4).alias("y")))
    return zones.where(F.size("vertices") >= 3).withColumn("vertices", share)


def to_world(df: DataFrame, homographies: DataFrame, x: str = "fx", y: str = "fy") -> DataFrame:
    """Add world_x, world_y (two decimals); NULL for cameras without a matrix."""
    h = homographies.withColumnRenamed("camera_id", "_c")
    j = join_dimension(df, h, "camera_id", "_c")
    row = lambda i: F.col(f"h{i}0") * F.col(x) + F.col(f"h{i}1") * F.col(y) + F.col(f"h{i}2")
    out = j.withColumn("world_x", F.bround(F.try_divide(row(0), row(2)), 2) + 0.0).withColumn("world_y", F.bround(F.try_divide(row(1), row(2)), 2) + 0.0)
    return out.drop(*h.columns)


def solve_homography(camera: np.ndarray, world: np.ndarray) -> np.ndarray:
    """3 x 3 matrix with last element 1: exact for four pairs, least squares for more."""
    rows, right = [], []
    for (x, y), (u, v) in zip(camera, world, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0], 1.0)


def _design(camera: np.ndarray, world: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equations of the eight unknowns for each pair: (..., pairs, 2, 8) and (..., pairs, 2)."""
    x, y, u, v = camera[..., 0], camera[..., 1], world[..., 0], world[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], -2)
    return rows, np.stack([u, v], -1)


def reprojection(h: np.ndarray, camera: np.ndarray, world: np.ndarray) -> np.ndarray:
    """Distances of the projected points from the world points, for each matrix (samples x 9)."""
    m = h.reshape(-1, 3, 3)
    p = np.einsum("sij,nj->sni", m, np.column_stack([camera, np.ones(len(camera))]))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.linalg.norm(p[..., :2] / p[..., 2:] - world, axis=-1)
    return np.where(np.isfinite(d), d, np.inf)


def consensus_homography(camera: np.ndarray, world: np.ndarray, within: float = 5.0, samples: int = 512, seed: int = 11) -> np.ndarray:
    """Matrix of the pairs that agree: many seeded samples of four pairs are solved at once, the one with
    most pairs `within` its projection (of equals the closest) wins, and its pairs are fitted together.

    Pairs that all agree give the plain fit, and so do those without any agreement.
    """
    plain = solve_homography(camera, world)
    if len(camera) == 4 or (reprojection(plain, camera, world) <= within).all():
        return plain
    rng = np.random.default_rng(seed)
    picks = np.argsort(rng.random((samples, len(camera))), axis=1)[:, :4]
    # samples are solved in coordinates of about one, so that a small determinant means points on a line
    size = np.maximum(camera.std(axis=0).max(), 1e-12), np.maximum(world.std(axis=0).max(), 1e-12)
    c, w = (camera - camera.mean(axis=0)) / size[0], (world - world.mean(axis=0)) / size[1]
    a, b = _design(c[picks], w[picks])
    a, b = a.reshape(samples, 8, 8), b.reshape(samples, 8, 1)
    good = np.abs(np.linalg.det(a)) > 1e-9
    if not good.any():
        return plain
    h = np.concatenate([np.linalg.solve(a[good], b[good])[..., 0], np.ones((int(good.sum()), 1))], axis=1)
    d = reprojection(h, c, w)
    near = d <= within / size[1]
    order = np.lexsort((np.where(near, d, 0.0).sum(axis=1), -near.sum(axis=1)))
    chosen = near[order[0]]
    return solve_homography(camera[chosen], world[chosen]) if chosen.sum() >= 4 else plain


def fit_homography(points: DataFrame, within: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Matrix per camera from pairs (camera_id, idx, cx, cy, wx, wy); fewer than four give none.

    Four pairs are solved exactly.  Of more, those that don't agree with the
    others within `within` world units are left out (consensus_homography).  A
    camera's pairs are a calibration of some points and fit a task.
    """
    names = [f"h{i}{k}" for i in range(3) for k in range(3)]
    keys = [*by, "camera_id"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 4:
            return pd.DataFrame(columns=[*keys, *names])
        p = pdf.sort_values("idx")
        h = consensus_homography(p[["cx", "cy"]].to_numpy(float), p[["wx", "wy"]].to_numpy(float), within)
        return pd.DataFrame([[*(p[k].iloc[0] for k in keys), *h]], columns=[*keys, *names])

    head = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.groupBy(*keys).applyInPandas(fit, head + ", " + ", ".join(f"{n} double" for n in names))


def gaussian_kernel(size: int = 25) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def smooth_density(grid: DataFrame, width: int = 320, height: int = 180, keys: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """Blur of counted cells (bx, by, n): value 0..255 and alpha (0 below 3, else 0.85 of it).

    A camera's grid has a fixed number of cells, so each fits a task.
    """
    k = gaussian_kernel()
    pad = len(k) // 2

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((height, width))
        g[pdf["by"], pdf["bx"]] = pdf["n"]
        for axis in (0, 1):
            p = np.pad(g, [(pad, pad) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
            g = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, p)
        top = g.max()
        v = np.floor(g / top * 255) if top > 0 else g
        y, x = np.nonzero(v)
        out = pd.DataFrame({"bx": x, "by": y, "value": v[y, x].astype(int)})
        out["alpha"] = np.where(out["value"] < 3, 0, (out["value"] * 0.85).astype(int))
        for key in reversed(keys):
            out.insert(0, key, pdf[key].iloc[0])
        return out

    head = ", ".join(f"{x} {grid.schema[x].dataType.simpleString()}" for x in keys)
    return grid.groupBy(*keys).applyInPandas(blur, f"{head}, bx int, by int, value int, alpha int")
