"""Gates on detector output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_detections(df: DataFrame, least: float, ratio: Column, class_id: int = 0) -> DataFrame:
    """Finite boxes of the class with a score above `least`; centre boxes become corners, scaled back by `ratio`."""
    values = ["cx", "cy", "w", "h", "score"]
    finite = F.lit(True)
    for v in values:
        finite = finite & F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    kept = df.where(finite & (F.col("score") > least) & (F.col("class_id") == class_id))
    side = lambda c, s, sign: (F.col(c) + sign * F.col(s) / 2) / ratio
    return kept.withColumns({"x1": side("cx", "w", -1), "y1": side("cy", "h", -1), "x2": side("cx", "w", 1), "y2": side("cy", "h", 1)})


def crop_quality_gate(df: DataFrame, width: int = 1920, height: int = 1080, margin: float = 0.05, area: int = 5000, sharpness: float = 5.0) -> DataFrame:
    """Boxes away from the frame's edge, large and sharp enough to identify a person."""
    mx, my = width * margin, height * margin
    inside = (F.col("x1") >= mx) & (F.col("y1") >= my) & (F.col("x2") <= width - mx) & (F.col("y2") <= height - my)
    large = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= area
    return df.where(inside & large & (F.col("sharpness") >= sharpness))


def nms(detections: DataFrame, iou: float = 0.45) -> DataFrame:
    """Greedy non-maximum suppression per (camera_id, frame), by score; a frame holds a few hundred boxes."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["score", "event_id"], ascending=[False, True])
        b = p[["x1", "y1", "x2", "y2"]].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        left, keep = np.arange(len(p)), []
        while len(left):
            i, rest = left[0], left[1:]
            keep.append(i)
            w = np.minimum(b[i, 2], b[rest, 2]) - np.maximum(b[i, 0], b[rest, 0])
            h = np.minimum(b[i, 3], b[rest, 3]) - np.maximum(b[i, 1], b[rest, 1])
            shared = np.maximum(w, 0) * np.maximum(h, 0)
            left = rest[shared / np.maximum(area[i] + area[rest] - shared, 1e-9) <= iou]
        return p.iloc[keep]

    return detections.groupBy("camera_id", "frame").applyInPandas(pick, detections.schema)
