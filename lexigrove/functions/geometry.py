"""Boxes, polygons and masks.

Boxes and polygons are array expressions.  Masks are packed bits (one row of the mask
after the other, most significant bit first) and go through Arrow-batched functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x0, y0, x1, y1]; 0 where a box is missing or the union is empty."""
    zero = F.lit(0.0)
    shared = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(zero, x[2] - x[0]) * F.greatest(zero, x[3] - x[1])
    union = area(a) + area(b) - shared
    return F.when(a.isNull() | b.isNull() | (F.size(a) != 4) | (F.size(b) != 4), 0.0).when(union > 0, shared / union).otherwise(0.0)


def box_of_points(xs: Column, ys: Column) -> Column:
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2)


def polygon_valid(xs: Column, ys: Column, least_area: float = 1.0) -> Column:
    """At least three different points and a real area."""
    return (F.size(F.array_distinct(F.arrays_zip(xs, ys))) >= 3) & (polygon_area(xs, ys) >= least_area)


def flat_valid(coords: Column) -> Column:
    """A flat coordinate list with an even number of at least six values."""
    return (F.size(coords) >= 6) & (F.size(coords) % 2 == 0)


def flat_normal(coords: Column, width: Column, height: Column, digits: int = 6) -> Column:
    """Flat x, y list as shares of the picture, clipped to 0..1."""
    clip = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), digits)
    return F.transform(coords, lambda v, i: clip(v / F.when(i % 2 == 0, width).otherwise(height)))


def flip(xs: Column, width: Column) -> Column:
    """Points mirrored left to right."""
    return F.transform(xs, lambda x: width - x)


def affine(xs: Column, ys: Column, matrix: list[float]) -> Column:
    """Points under [a, b, c, d, e, f] as an array of structs (x, y)."""
    a, b, c, d, e, f = matrix
    return F.zip_with(xs, ys, lambda x, y: F.struct((x * a + y * b + c).alias("x"), (x * d + y * e + f).alias("y")))


# -- masks ---------------------------------------------------------------------------


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool)).tobytes()


def unpack(data: bytes | None, width: int, height: int) -> np.ndarray:
    if not data:
        return np.zeros((height, width), bool)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=width * height).astype(bool).reshape(height, width)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    """Two empty masks agree completely."""
    union = np.logical_or(a, b).sum()
    return 1.0 if not union else float(np.logical_and(a, b).sum() / union)


@F.pandas_udf(T.DoubleType())
def mask_iou(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([iou(unpack(x, w, h), unpack(y, w, h)) for x, y, w, h in zip(a, b, width, height)])


def largest_component(mask: np.ndarray, keep_if_empty: bool = True) -> np.ndarray:
    """The eight-connected component with most pixels (the first found of equals)."""
    labels, count = components(mask)
    if not count:
        return mask.copy() if keep_if_empty else mask
    sizes = np.bincount(labels.ravel(), minlength=count + 1)
    return labels == int(np.argmax(sizes[1:])) + 1


def runs(mask: np.ndarray, connected: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Horizontal runs of a mask in reading order: (row, first column, column after the last, label) and the number of labels.

    Runs of neighbouring rows that touch have one label, found by union of runs; labels count from 1 in reading order.
    """
    height, width = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (rows, starts), ends = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    reach, step = (1 if connected == 8 else 0), width + 3
    # runs of the row above that end after this one begins and begin before it ends: consecutive in reading order
    low = np.searchsorted(rows * step + ends, (rows - 1) * step + starts - reach, side="right")
    high = np.searchsorted(rows * step + starts, (rows - 1) * step + ends + reach, side="left")
    count = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(rows)), count)
    above = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    boss = list(range(len(rows)))
    for a, b in zip(above.tolist(), below.tolist()):
        while boss[a] != a:
            boss[a] = boss[boss[a]]
            a = boss[a]
        while boss[b] != b:
            boss[b] = boss[boss[b]]
            b = boss[b]
        if a != b:
            boss[max(a, b)] = min(a, b)
    top = np.array(boss, np.int64)
    while len(top) and (top[top] != top).any():
        top = top[top]
    firsts, labels = np.unique(top, return_inverse=True)
    return rows, starts, ends, labels + 1, len(firsts)


def components(mask: np.ndarray, connected: int = 8) -> tuple[np.ndarray, int]:
    """Labels of the eight- (or four-) connected components in reading order."""
    labels = np.zeros(mask.shape, np.int32)
    if mask.size:
        rows, starts, ends, own, count = runs(mask.astype(bool), connected)
        labels[mask.astype(bool)] = np.repeat(own, ends - starts)
        return labels, count
    return labels, 0


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that the border cannot reach (four-connected) becomes part of the mask."""
    labels, _ = components(np.pad(~mask, 1, constant_values=True), 4)
    return ~(labels == labels[0, 0])[1:-1, 1:-1]


def smooth(scores: np.ndarray, kernel: int) -> np.ndarray:
    """Mean over a square of odd size, edges repeated."""
    if kernel <= 1:
        return scores
    half = kernel // 2
    padded = np.pad(scores.astype(float), half, mode="edge")
    sums = np.pad(padded, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (sums[kernel:, kernel:] - sums[:-kernel, kernel:] - sums[kernel:, :-kernel] + sums[:-kernel, :-kernel]) / kernel**2


def resize(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour."""
    rows = (np.arange(height) * mask.shape[0] // height).clip(0, mask.shape[0] - 1)
    cols = (np.arange(width) * mask.shape[1] // width).clip(0, mask.shape[1] - 1)
    return mask[rows][:, cols]


def thin(mask: np.ndarray) -> np.ndarray:
    """One pixel wide skeleton: border pixels go in two alternating passes while the shape stays connected."""
    image = np.pad(mask.astype(np.uint8), 1)
    changed = True
    while changed:
        changed = False
        for odd in (0, 1):
            p = [image[:-2, 1:-1], image[:-2, 2:], image[1:-1, 2:], image[2:, 2:], image[2:, 1:-1], image[2:, :-2], image[1:-1, :-2], image[:-2, :-2]]
            turns = sum((p[i] == 0) & (p[(i + 1) % 8] == 1) for i in range(8))
            around = sum(x.astype(int) for x in p)
            n, e, s, w = p[0], p[2], p[4], p[6]
            corner = (n * e * s == 0) & (e * s * w == 0) if odd == 0 else (n * e * w == 0) & (n * s * w == 0)
            gone = (image[1:-1, 1:-1] == 1) & (around >= 2) & (around <= 6) & (turns == 1) & corner
            if gone.any():
                image[1:-1, 1:-1][gone] = 0
                changed = True
    return image[1:-1, 1:-1].astype(bool)


def skeleton_length(skeleton: np.ndarray) -> float:
    """Straight neighbours count 1, diagonal ones the square root of 2 where no straight step joins them."""
    s = skeleton
    straight = (s[:, 1:] & s[:, :-1]).sum() + (s[1:] & s[:-1]).sum()
    down = s[1:, 1:] & s[:-1, :-1] & ~s[:-1, 1:] & ~s[1:, :-1]
    up = s[1:, :-1] & s[:-1, 1:] & ~s[:-1, :-1] & ~s[1:, 1:]
    return float(straight + np.sqrt(2.0) * (down.sum() + up.sum()))


MEASURES = T.StructType(
    [T.StructField("area_pixels", T.LongType()), T.StructField("area_ratio", T.DoubleType()), T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("length_px", T.DoubleType()), T.StructField("mean_width_px", T.DoubleType())]
)


@F.pandas_udf(MEASURES)
def mask_measures(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Area, share of the frame (8 decimals), bounding box, crack length and mean width of packed masks."""
    rows = []
    for d, w, h in zip(data, width, height):
        mask = unpack(d, w, h)
        area = int(mask.sum())
        if not area:
            rows.append((0, 0.0, None, 0.0, 0.0))
            continue
        ys, xs = np.nonzero(mask)
        length = skeleton_length(thin(mask))
        rows.append((area, round(area / (w * h), 8), [float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)], length, area / length if length else float(np.sqrt(area))))
    return pd.DataFrame(rows, columns=["area_pixels", "area_ratio", "box", "length_px", "mean_width_px"])
