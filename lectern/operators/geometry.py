"""Page geometry: columns and reading order of lines, and rectangles of a range of characters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GUTTER, SHARE, DEPTH = 0.04, 0.25, 2


def column_cut(boxes: np.ndarray, width: float, bins: int = 200) -> float | None:
    """Where a page parts into two columns: the middle of the widest gap that few lines cross, if it is wide enough and each side has its share."""
    if len(boxes) < 4 or width <= 0:
        return None
    lo = np.clip((boxes[:, 0] / width * bins).astype(int), 0, bins - 1)
    hi = np.clip(np.ceil(boxes[:, 2] / width * bins).astype(int), 1, bins)
    cover = np.zeros(bins + 1)
    np.add.at(cover, lo, 1)
    np.add.at(cover, hi, -1)
    free = np.cumsum(cover)[:bins] <= 0.05 * len(boxes)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free, [0]))))
    gaps = [(b - a, a, b) for a, b in zip(edges[::2], edges[1::2]) if a > lo.min() and b < hi.max()]
    if not gaps:
        return None
    size, a, b = max(gaps)
    cut = (a + b) / 2 / bins * width
    left = (boxes[:, 2] <= cut).mean()
    right = (boxes[:, 0] >= cut).mean()
    return cut if size / bins >= GUTTER and min(left, right) >= SHARE else None


def reading_order(boxes: np.ndarray, width: float, depth: int = DEPTH) -> np.ndarray:
    """Column number of each line: columns from left to right, cut again up to depth times; lines across a cut go with the left."""
    cut = column_cut(boxes, width) if depth else None
    if cut is None:
        return np.zeros(len(boxes), int)
    right = boxes[:, 0] >= cut
    out = np.zeros(len(boxes), int)
    out[~right] = reading_order(boxes[~right], width, depth - 1)
    out[right] = reading_order(boxes[right], width, depth - 1) + out[~right].max(initial=0) + 1
    return out


def page_columns(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines (page keys, line, box, width) with column and place in reading order; a page's lines are one group."""
    schema = lines.select(*page, "line").schema.add("column", "integer").add("place", "integer")

    def order(group: pd.DataFrame) -> pd.DataFrame:
        boxes = np.array(group["box"].tolist(), float).reshape(-1, 4)
        out = group[[*page, "line"]].assign(column=reading_order(boxes, float(group["width"].iloc[0])), top=boxes[:, 1])
        out = out.sort_values(["column", "top", "line"], kind="stable")
        out["place"] = np.arange(1, len(out) + 1)
        return out.drop(columns="top")

    return lines.groupBy(*page).applyInPandas(order, schema)


def range_rects(lines: list[dict], start: int, end: int, most: int = 4) -> list[tuple[int, float, float, float, float]]:
    """Rectangles (page, x, y, width, height) of characters start to end of the lines' texts joined by line ends; the first `most`."""
    out, at = [], 0
    for line in lines:
        a, b = max(start - at, 0), min(end - at, len(line["text"]))
        if a < b:
            edges = line["edges"] or list(np.linspace(line["box"][0], line["box"][2], len(line["text"]) + 1))
            x0, x1 = edges[min(a, len(edges) - 1)], edges[min(b, len(edges) - 1)]
            out.append((line["page"], x0, line["box"][1], x1 - x0, line["box"][3] - line["box"][1]))
        at += len(line["text"]) + 1
    return out[:most]
