"""Matching inside groups: greedy one-to-one pairs, nearest values, overlapping regions."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probes import iou
from .shared import materialize

cloudpickle.register_pickle_by_value(sys.modules["provquill"])


def greedy_pairs(candidates: DataFrame, by: str, left: str, right: str, score: str, least: float = 0.0) -> DataFrame:
    """Pairs taken from the highest score on (ties by left, then right), each side used once.

    A pair that is the best of both its sides is taken whatever the rest holds, so every round takes all such pairs
    of all groups at once and drops what they touch; no group is gathered in one task.  Rounds are as many as the
    longest chain of pairs that wait for a better one, and each is written to the shared folder.
    """
    order = (F.desc("_s"), F.col("_l"), F.col("_r"))
    rest = materialize(candidates.where(F.col(score) >= least).select(F.col(by).alias("_by"), F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(score).alias("_s")), "candidates")
    taken: DataFrame | None = None
    while True:
        ranked = rest.withColumn("_a", F.row_number().over(Window.partitionBy("_by", "_l").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("_by", "_r").orderBy(*order)))
        best = materialize(ranked.where("_a = 1 AND _b = 1").select("_by", "_l", "_r", "_s"), "taken")
        taken = best if taken is None else taken.union(best)
        if best.isEmpty():
            return taken.select(F.col("_by").alias(by), F.col("_l").alias(left), F.col("_r").alias(right), F.col("_s").alias(score))
        rest = materialize(rest.join(best.select("_by", "_l"), ["_by", "_l"], "left_anti").join(best.select("_by", "_r"), ["_by", "_r"], "left_anti").select("_by", "_l", "_r", "_s"), "candidates")


def nearest_taken(left: list[tuple[float, int]], right: list[tuple[float, int]], most: float) -> Iterator[tuple[int, int, float]]:
    """(left key, right key, distance): pairs of (value, key) taken from the least distance on, ties by left, then right key, each key used once.

    Keys of one value wait in one queue, so the pairs of values are looked at and never the pairs of keys.
    """
    sides = []
    for items in (left, right):
        queues: dict[float, list[int]] = {}
        for value, key in sorted(set(items), key=lambda x: x[1]):
            queues.setdefault(value, []).append(key)
        sides.append(queues)
    lefts, rights = sides
    values: dict[float, dict[float, list[float]]] = {}
    for x in lefts:
        for y in rights:
            if abs(x - y) <= most:
                values.setdefault(abs(x - y), {}).setdefault(x, []).append(y)
    at = dict.fromkeys(rights, 0)
    used: tuple[set[int], set[int]] = (set(), set())

    def head(y: float) -> int | None:
        keys, k = rights[y], at[y]
        while k < len(keys) and keys[k] in used[1]:
            k += 1
        at[y] = k
        return keys[k] if k < len(keys) else None

    for distance in sorted(values):
        near = values[distance]
        asked = [x for x, ys in near.items() if any(head(y) is not None for y in ys)]
        for key, same in groupby(merge(*([(k, x) for k in lefts[x]] for x in asked)), itemgetter(0)):
            if key not in used[0]:
                r = min((k for _, x in same for y in near[x] if (k := head(y)) is not None), default=None)
                if r is not None:
                    used[0].add(key)
                    used[1].add(r)
                    yield key, r, distance
        for x in asked:
            lefts[x] = [k for k in lefts[x] if k not in used[0]]


def nearest_pairs(items: DataFrame, by: list[str], key: str, value: str, is_left: str, most: float) -> DataFrame:
    """(by..., l, r, distance): left items matched with right ones of their group, the nearest values first.

    The same as greedy_pairs over all pairs with a score that falls with the distance, without making these pairs:
    a task holds the keys and values of a group, and goes through the pairs of its distinct values.
    """
    group = [F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)]
    rows = items.select(*group, F.col(key).cast("long").alias("_key"), F.col(value).cast("double").alias("_value"), F.col(is_left).alias("_left")).dropna()
    names = [f"_by{k}" for k in range(len(by))]

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for k, v, on_left in zip(*(table.column(c).to_pylist() for c in ("_key", "_value", "_left")), strict=True):
            sides[not on_left].append((v, k))
        out = list(nearest_taken(*sides, most))
        groups = [pa.array([table.column(c)[0].as_py()] * len(out), table.schema.field(c).type) for c in names]
        return pa.Table.from_arrays([*groups, *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], names=[*names, "l", "r", "distance"])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), "l long", "r long", "distance double"])
    found = rows.groupBy(*names).applyInArrow(run, schema)
    return found.select(*[F.col(c).alias(b) for c, b in zip(names, by, strict=True)], "l", "r", "distance")


def overlapping_pairs(items: DataFrame, by: list[str], key: str, region: str, least: float) -> DataFrame:
    """(left_key, right_key): items of one group, the smaller key on the left, whose regions have an IoU of least or more.

    The overlap is computed for the distinct regions of a group, and of these for ones of similar area only (an IoU of
    t needs areas within a factor of 1 / t); items then meet in an equality join with the regions near their own, so
    rows are made for the result and not for all pairs of a group.
    """
    if not 0 < least <= 1:
        raise ValueError("the least overlap is above 0 and at most 1")
    names = [f"_by{k}" for k in range(len(by))]
    known = items.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], F.col(key).alias("_key"), F.col(region).alias("_region"))
    area = F.col("_region.w").cast("double") * F.col("_region.h")
    width = max(-math.log(least), 1e-6) * (1 + 1e-9)
    boxes = materialize(known.select(*names, "_region").distinct().where(area > 0).withColumn("_bin", F.floor(F.log(area) / width)).withColumn("_box", F.monotonically_increasing_id()), "regions")
    a = boxes.select(*names, F.col("_region").alias("_ra"), F.col("_box").alias("_a"), F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin"))
    b = boxes.select(*names, "_bin", F.col("_region").alias("_rb"), F.col("_box").alias("_b"))
    near = materialize(a.join(b, [*names, "_bin"]).where((F.col("_a") <= F.col("_b")) & (iou(F.col("_ra"), F.col("_rb")) >= least)).select("_a", "_b"), "near-regions")
    members = materialize(known.join(boxes, [*names, "_region"]).select("_box", "_key"), "region-items")
    left = members.select(F.col("_box").alias("_a"), F.col("_key").alias("_x")).join(near, "_a")
    both = left.join(members.select(F.col("_box").alias("_b"), F.col("_key").alias("_y")), "_b")
    # Items of one region meet in both orders, those of two regions once.
    both = both.where("CASE WHEN _a = _b THEN _x < _y ELSE _x <> _y END")
    return both.select(F.least("_x", "_y").alias("left_key"), F.greatest("_x", "_y").alias("right_key"))
