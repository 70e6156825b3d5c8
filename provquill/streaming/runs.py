"""Streaming forms: run acceptance over frames, and windowed verdict counts.

Only the causal part of the frame arbiter streams: runs, their length and their strength.  Cover before the first
confirmed frame needs the whole sequence and stays a batch operator.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import MAX_GAP, STABLE_IOU, overlap

cloudpickle.register_pickle_by_value(sys.modules["provquill"])

ACCEPTED = "sequence long, run long, first_frame long, last_frame long, n long, top double, n_late long"
_STATE = "run long, first_frame long, last_frame long, n long, top double, n_late long, x double, y double, w double, h double"


def accepted_runs(frames: DataFrame, weak: float, strong: float, min_frames: int, timeout_ms: int | None = None) -> DataFrame:
    """Runs of a stream of (sequence, frame_index, confidence, x, y, w, h), each emitted when it ends and qualifies.

    A run ends at a wider gap, at a moved region, or, given a timeout, when its sequence is silent for so long; what is
    open when the stream stops is in its state, from which open_runs() reads it.  A trigger's frames of a sequence
    are put in order; frames that arrive behind the open run are left out and counted in n_late of the next run to
    end.  State is one open run per sequence.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []

        def close(run: tuple) -> None:
            if run[3] >= min_frames and run[4] >= strong:
                done.append((key[0], *run[:6]))

        if state.hasTimedOut:
            close(state.get)
            state.remove()
        else:
            open_run = state.get if state.exists else None
            rows = pd.concat(list(parts)).sort_values("frame_index")
            for f, c, x, y, w, h in zip(*(rows[n] for n in ("frame_index", "confidence", "x", "y", "w", "h")), strict=True):
                if pd.isna(x) or c < weak:
                    continue
                if open_run and f <= open_run[2]:
                    open_run = (*open_run[:5], open_run[5] + 1, *open_run[6:])
                    continue
                region = (float(x), float(y), float(w), float(h))
                if open_run and f - open_run[2] <= MAX_GAP + 1 and overlap(open_run[6:], region) >= STABLE_IOU:
                    open_run = (open_run[0], open_run[1], int(f), open_run[3] + 1, max(open_run[4], float(c)), open_run[5], *region)
                else:
                    if open_run:
                        close(open_run)
                    open_run = ((open_run[0] if open_run else 0) + 1, int(f), int(f), 1, float(c), 0, *region)
            if open_run:
                state.update(open_run)
                if timeout_ms is not None:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(done, columns=[c.split(" ")[0] for c in ACCEPTED.split(", ")])

    return frames.groupBy("sequence").applyInPandasWithState(step, ACCEPTED, _STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def open_runs(spark: SparkSession, checkpoint: str, strong: float, min_frames: int) -> DataFrame:
    """The qualifying runs that are still open in the state of a stopped accepted_runs() stream, as it would have emitted them."""
    state = spark.read.format("statestore").load(checkpoint)
    runs = state.select("key.*", "value.groupState.*") if "groupState" in state.schema["value"].dataType.names else state.select("key.*", "value.*")
    return runs.where((F.col("n") >= min_frames) & (F.col("top") >= strong)).select(*[c.split(" ")[0] for c in ACCEPTED.split(", ")])


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts per tumbling window and key, with a watermark that bounds the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
