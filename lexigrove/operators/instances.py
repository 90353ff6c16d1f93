"""Segmentation instances: overlapping same-class masks joined, findings aggregated, boxes joined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_iou, iou, pack, unpack

MERGED = "image_id string, class_id int, group_no int, member_ids array<int>, score double, best_id int, mask binary, box array<double>, area_pixels long"


def merge_instances(instances: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Union of masks whose overlap chains reach ``threshold``, per image and class.

    ``instances``: image_id, class_id, instance_id, score, mask (packed bits), width, height.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("instance_id")
        rows = list(own.itertuples())
        masks = [unpack(r.mask, r.width, r.height) for r in rows]
        boss = list(range(len(rows)))

        def find(i: int) -> int:
            while boss[i] != i:
                boss[i] = boss[boss[i]]
                i = boss[i]
            return i

        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if iou(masks[i], masks[j]) >= threshold:
                    a, b = find(i), find(j)
                    if a != b:
                        boss[b] = a
        groups: dict[int, list[int]] = {}
        for i in range(len(rows)):
            groups.setdefault(find(i), []).append(i)
        out = []
        for number, members in enumerate(groups.values(), 1):
            best = max(members, key=lambda i: rows[i].score)
            union = np.logical_or.reduce([masks[i] for i in members])
            ys, xs = np.nonzero(union)
            box = [float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)] if len(xs) else None
            out.append((rows[0].image_id, rows[0].class_id, number, [rows[i].instance_id for i in members], rows[best].score, rows[best].instance_id, pack(union), box, int(union.sum())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])

    return instances.groupBy("image_id", "class_id").applyInPandas(run, MERGED)


def box_pairs(boxes: DataFrame, least: float, by: list[str], key: str, box: str = "box", cell: float | None = None) -> DataFrame:
    """Pairs of boxes of one group whose overlap reaches ``least`` (> 0), the smaller key first.

    With ``cell`` boxes meet on a grid of that width, so that a large group is not compared
    pair by pair; each pair is found in the cell of its overlap's corner only.
    """
    side = lambda name: boxes.select(*by, F.col(key).alias(name), *[F.get(F.col(box), i).cast("double").alias(f"{name}{i}") for i in range(4)])
    a, b = side("a"), side("b")
    low = [F.greatest(f"a{i}", f"b{i}") for i in (0, 1)]
    width, height = (F.least(f"a{i + 2}", f"b{i + 2}") - low[i] for i in (0, 1))
    near = (F.col("a") < F.col("b")) & (width > 0) & (height > 0)
    if cell:
        grid = lambda c: F.floor(F.col(c) / cell)
        spread = lambda f, c: f.withColumn("cx", F.explode(F.sequence(grid(f"{c}0"), grid(f"{c}2")))).withColumn("cy", F.explode(F.sequence(grid(f"{c}1"), grid(f"{c}3"))))
        met = spread(a, "a").join(spread(b, "b"), [*by, "cx", "cy"]).where(near & (F.floor(low[0] / cell) == F.col("cx")) & (F.floor(low[1] / cell) == F.col("cy")))
    else:
        met = a.join(b, by).where(near)
    area = lambda c: (F.col(f"{c}2") - F.col(f"{c}0")) * (F.col(f"{c}3") - F.col(f"{c}1"))
    shared = width * height
    return met.select(*by, "a", "b", (shared / (area("a") + area("b") - shared)).alias("iou")).where(F.col("iou") >= least)


def class_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Class names by id, ``class_<id>`` where there is none."""
    return rows.join(names, "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))
