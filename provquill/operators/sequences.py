"""Frame sequences: run segmentation, acceptance, gap filling, cover, priority choice, tiles.

Frames are rows (sequence, frame_index, confidence, region STRUCT<x,y,w,h>); a sequence is one video's frames for
one mark, so windows partition by sequence and a sequence's frames are ordered, never the whole table.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.probes import iou

cloudpickle.register_pickle_by_value(sys.modules["provquill"])

#: Missing frames that a run may bridge, and the overlap that keeps it.
MAX_GAP, STABLE_IOU = 2, 0.55


@dataclass(frozen=True)
class Policy:
    weak: float
    strong: float
    transition: float
    min_frames: int
    cover: bool = False
    anchor_iou: float | None = None


# Policies of video marks (weak, strong and transition floors, least frames, cover, anchor overlap).
POLICIES = {
    "sora": Policy(0.60, 0.65, 0.45, 5),
    "veo": Policy(0.50, 0.55, 0.35, 12, True),
    "seedance": Policy(0.38, 0.43, 0.30, 12, True, 0.80),
    "dola": Policy(0.50, 0.52, 0.40, 12, True, 0.80),
    "hailuo": Policy(0.30, 0.34, 0.28, 12, True, 0.80),
    "kling": Policy(0.20, 0.24, 0.30, 12, True, 0.80),
}
# Weak floors under provenance, and marks that provenance does not relax.
PROVENANCE_WEAK = {"sora": 0.58, "veo": 0.45, "dola": 0.48}
NEVER_RELAXED = ("kling",)


def runs(frames: DataFrame, weak: float, by: str = "sequence", max_gap: int = MAX_GAP, stable: float = STABLE_IOU) -> DataFrame:
    """Candidates of at least weak confidence with their run: a run breaks at a wider gap or a moved region."""
    w = Window.partitionBy(by).orderBy("frame_index")
    seen = frames.where(f"region IS NOT NULL AND confidence >= {weak}")
    before = F.lag("region").over(w)
    broken = (F.col("frame_index") - F.lag("frame_index").over(w) > max_gap + 1) | (iou(before, F.col("region")) < stable)
    marked = seen.withColumn("_new", F.when(F.lag("frame_index").over(w).isNull() | broken, 1).otherwise(0))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def anchored_runs(frames: DataFrame, weak: float, anchor: float, by: str = "sequence", max_gap: int = MAX_GAP, stable: float = STABLE_IOU) -> DataFrame:
    """runs() that also break where the region leaves the run's first region.

    Whether a frame opens a run depends on where the last run began, so a sequence's candidates are walked in order
    by one task; nothing but their numbers is held.
    """
    seen = frames.where(f"region IS NOT NULL AND confidence >= {weak}").select(by, "frame_index", "confidence", "region")

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_index")
        frame = rows.column("frame_index").to_pylist()
        region = [tuple(r[k] for k in "xywh") for r in rows.column("region").to_pylist()]
        found, first = [], 0
        for k, (f, r) in enumerate(zip(frame, region, strict=True)):
            if not k or f - frame[k - 1] > max_gap + 1 or overlap(region[k - 1], r) < stable or overlap(region[first], r) < anchor:
                first = k
            found.append(found[-1] + (first == k) if found else 1)
        return rows.append_column("run", pa.array(found, pa.int64()))

    return seen.groupBy(by).applyInArrow(walk, StructType([*seen.schema.fields, StructField("run", LongType())]))


def overlap(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Intersection over union of two regions (x, y, w, h); 0 for an empty union."""
    width = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    height = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - width * height
    return width * height / union if union > 0 else 0.0


def accepted_runs(segmented: DataFrame, min_frames: int, strong: float, provenance: Column | bool = False, by: str = "sequence") -> DataFrame:
    """Frames of runs that are long enough and, unless provenance vouches, once strong."""
    w = Window.partitionBy(by, "run")
    vouched = F.lit(provenance) if isinstance(provenance, bool) else provenance
    ok = (F.count("*").over(w) >= min_frames) & (vouched | (F.max("confidence").over(w) >= strong))
    return segmented.withColumn("_ok", ok).where("_ok").drop("_ok")


def stabilize(frames: DataFrame, policy: Policy, provenance: bool = False, by: str = "sequence") -> DataFrame:
    """Adds accepted (a region or null) to every frame of frame_index order.

    Inside an accepted run a missing frame takes the nearer end's region (left on a tie) while both ends agree.
    With cover or provenance every other frame takes its own candidate, if it is over the transition floor and
    near a confirmed region, or else the last confirmed region, or the first one before any.
    """
    found = anchored_runs(frames, policy.weak, policy.anchor_iou, by) if policy.anchor_iou is not None else runs(frames, policy.weak, by)
    good = accepted_runs(found, policy.min_frames, policy.strong, provenance, by).select(by, "frame_index", F.col("region").alias("_kept"), "run")
    order = Window.partitionBy(by).orderBy("frame_index")
    df = frames.join(good, [by, "frame_index"], "left").withColumn("_pos", F.row_number().over(order))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    spot = F.when(F.col("_kept").isNotNull(), F.struct("_kept", "_pos", "run"))
    df = df.withColumns({"_l": F.last(spot, True).over(back), "_r": F.first(spot, True).over(ahead)})
    inside = (F.col("_l.run") == F.col("_r.run")) & (iou(F.col("_l._kept"), F.col("_r._kept")) >= STABLE_IOU)
    filled = F.when(F.col("_kept").isNotNull(), F.col("_kept")).when(inside, F.when(F.col("_pos") - F.col("_l._pos") <= F.col("_r._pos") - F.col("_pos"), F.col("_l._kept")).otherwise(F.col("_r._kept")))
    df = df.withColumn("accepted", filled)
    if policy.cover or provenance:
        # Each distinct region is held against the distinct confirmed ones of its sequence, not every frame against all.
        confirmed = df.where("accepted IS NOT NULL").select(F.col(by).alias("_by"), F.col("accepted").alias("_near")).distinct()
        asked = df.where(f"region IS NOT NULL AND accepted IS NULL AND confidence >= {policy.transition}").select(by, "region").distinct()
        near = asked.join(confirmed, (F.col(by) == F.col("_by")) & (iou(F.col("region"), F.col("_near")) >= STABLE_IOU), "left_semi").withColumn("_own", F.lit(True))
        df = df.join(near, [by, "region"], "left")
        own = F.col("_own") & (F.col("confidence") >= policy.transition)
        carried = F.coalesce(F.last("accepted", True).over(back), F.first("accepted", True).over(ahead))
        df = df.withColumn("accepted", F.coalesce("accepted", F.when(own, F.col("region")), carried))
    return df.select(*frames.columns, "accepted")


def stabilize_mark(frames: DataFrame, mark: str, provenance: bool = False, by: str = "sequence") -> DataFrame:
    """stabilize() under a mark's own policy; provenance never makes a detection, it only relaxes the floors."""
    trusted = provenance and mark not in NEVER_RELAXED
    policy = POLICIES[mark]
    return stabilize(frames, replace(policy, weak=PROVENANCE_WEAK.get(mark, policy.weak)) if trusted else policy, trusted, by)


def first_stable(marks: DataFrame, by: str, priority: str) -> DataFrame:
    """The row of the least priority of each group."""
    return marks.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(priority))).where("_r = 1").drop("_r")


def variable_interval(frames: DataFrame, by: str, ts: str, tolerance: float = 1e-3) -> DataFrame:
    """Whether a sequence's timestamps are unevenly spaced."""
    gap = F.lead(ts).over(Window.partitionBy(by).orderBy(ts)) - F.col(ts)
    return frames.withColumn("_g", gap).groupBy(by).agg((F.max("_g") - F.min("_g") > tolerance).alias("variable"))


def line_groups(boxes: DataFrame, by: str, top: str, height: str, overlap: float = 0.5) -> DataFrame:
    """Boxes numbered by line: a box starts a line when it overlaps the line's running bottom by too little."""
    w = Window.partitionBy(by).orderBy(top, height)
    reach = F.max(F.col(top) + F.col(height)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (reach - F.col(top) < overlap * F.col(height)), 1).otherwise(0)
    return boxes.withColumn("_n", new).withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def axis_positions(size: Column, tile: int, overlap: int) -> Column:
    """Tile offsets along an axis: even steps, the last tile flush with the end."""
    step = tile - overlap
    inner = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), size - tile), F.lit(step)), lambda p: p + tile <= size)
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(inner, F.array(size - tile))))


def tiles(df: DataFrame, width: str, height: str, tile: int, overlap: int) -> DataFrame:
    return df.withColumn("tile_x", F.explode(axis_positions(F.col(width), tile, overlap))).withColumn("tile_y", F.explode(axis_positions(F.col(height), tile, overlap)))
