"""The same operators on arriving frames and review actions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spotrace.model import FRAME_SIDE
from spotrace.operators.events import fold_actions
from spotrace.operators.images import BROADCAST_CELL_BOXES, _cells, region_of
from spotrace.session import broadcast_if_small, is_small


def acquisition_time(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``acquired_at``: the recording's ``started_at`` plus frame number times frame interval."""
    starts = broadcast_if_small(manifest.select("datum", "started_at", "time_interval_s"))
    micros = F.unix_micros("started_at") + (F.col("frame") * F.col("time_interval_s") * 1_000_000).cast("long")
    return rows.join(starts, "datum").withColumn("acquired_at", F.timestamp_micros(micros)).drop(
        "time_interval_s", "started_at")


def _timed(rows: DataFrame, manifest: DataFrame | None, lateness: str) -> tuple[DataFrame, list[str]]:
    """Rows under a watermark, where the manifest knows real start times; else as they are."""
    if manifest is None or "started_at" not in manifest.columns:
        return rows, []
    return acquisition_time(rows, manifest).withWatermark("acquired_at", lateness), ["acquired_at"]


def region_intensity_stream(
    pixels: DataFrame, manifest: DataFrame | None = None, side: int = FRAME_SIDE, lateness: str = "10 seconds"
) -> DataFrame:
    """Quadrant sums per frame.

    With ``started_at`` in the manifest, frames carry their real acquisition time: state older than the
    watermark goes, append mode emits a frame once, and pixels later than ``lateness`` are late for good.
    Without it there is no common clock, so no watermark: recordings may start and end in any order,
    nothing is dropped, state stays, and update mode gives a frame's sum so far.
    """
    inside = F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)
    timed, time = _timed(pixels.filter(inside), manifest, lateness)
    region = region_of(F.col("y"), F.col("x"), side // 2).alias("region")
    return timed.groupBy("datum", region, "frame", *time).agg(F.sum("v").alias("raw"))


def box_intensity_stream(
    pixels: DataFrame, boxes: DataFrame, manifest: DataFrame | None = None, lateness: str = "10 seconds"
) -> DataFrame:
    """Trace samples of arriving pixels against a stored box table; time as in :func:`region_intensity_stream`."""
    cells = _cells(boxes, "datum", "trace_num")
    if is_small(boxes, BROADCAST_CELL_BOXES):
        cells = F.broadcast(cells)  # at most 27 x 27 cells per box
    timed, time = _timed(pixels.join(cells, ["datum", "y", "x"]), manifest, lateness)
    return timed.groupBy("datum", "trace_num", "frame", *time).agg((F.sum("v") / F.max("width")).alias("raw"))


def fold_actions_stream(actions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Review state per trace, updated as actions arrive; the state is one row per trace."""
    return fold_actions(actions, manifest)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# The state store that keeps lists and several states per key (fixed name).
LIST_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_PIXEL = T.StructType([
    T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("v", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])
COMPLETED = T.StructType([
    T.StructField("datum", T.IntegerType()), T.StructField("frame", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("pixels", T.ArrayType(T.DoubleType())), T.StructField("beside", T.ArrayType(_PIXEL)),
])


class FrameCompletion(StatefulProcessor):
    """Collects the pixels of one (datum, frame) until each of its cells has one.

    While a frame is incomplete its state is a bitmap of the cells that are there and a list of the parts that
    brought them, so a batch writes what it brings and not the frame again.  A complete frame leaves and
    its state shrinks to its size, which tells later pixels that they are late.
    """

    def __init__(self, height: int, width: int):
        self.height, self.width = height, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "cells binary")
        self.parts = handle.getListState("parts", "places binary, values binary")
        self.done = handle.getValueState("done", "cells int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values=None) -> Iterator[pd.DataFrame]:
        size = self.height * self.width
        finished = self.done.exists()
        bits = np.zeros(size, bool)
        if not finished and self.seen.exists():
            bits = np.unpackbits(np.frombuffer(bytes(self.seen.get()[0]), np.uint8), count=size).astype(bool)
        beside: list[tuple] = []
        for batch in rows:
            y, x, v = (batch[c].to_numpy() for c in ("y", "x", "v"))
            inside = (y >= 0) & (y < self.height) & (x >= 0) & (x < self.width)
            place = np.where(inside, y * self.width + x, 0).astype(np.int64)
            first = np.zeros(len(place), bool)
            first[np.unique(place, return_index=True)[1]] = True
            # A cell's first pixel counts; the first row at place 0 may be one from outside.
            first = first | (place == 0) & inside & (np.cumsum((place == 0) & inside) == 1)
            reason = np.where(~inside, "outside", np.where(finished, "late", np.where(bits[place] | ~first, "repeated", "")))
            new = reason == ""
            if new.any():
                bits[place[new]] = True
                self.parts.appendValue((place[new].astype("<i4").tobytes(), v[new].astype("<f8").tobytes()))
            beside += zip(y[~new].tolist(), x[~new].tolist(), v[~new].tolist(), reason[~new].tolist())
        whole = None
        if not finished and bits.all():
            whole = np.empty(size)
            for places, values in self.parts.get():
                whole[np.frombuffer(bytes(places), "<i4")] = np.frombuffer(bytes(values), "<f8")
            self.parts.clear()
            self.seen.clear()
            self.done.update((size,))
        elif not finished:
            self.seen.update((np.packbits(bits).tobytes(),))
        if whole is not None or beside:
            yield pd.DataFrame({
                "datum": [key[0]], "frame": [key[1]], "height": [self.height], "width": [self.width],
                "pixels": [whole], "beside": [[dict(zip(("y", "x", "v", "reason"), p)) for p in beside]],
            })

    def close(self) -> None:
        pass


def use_list_store(spark: SparkSession) -> None:
    """Let streams of this session keep their state where :func:`complete_frames` needs it."""
    spark.conf.set(STATE_STORE, LIST_STORE)


def complete_frames(pixels: DataFrame, height: int = FRAME_SIDE, width: int = FRAME_SIDE) -> DataFrame:
    """Packed frames of arriving pixels, each emitted once, in the batch that brings its last cell (append mode).

    Recordings and frames may come in any order, back-filled or side by side: nothing waits for a clock.  State
    holds the pixels of incomplete frames, and one number for a complete one.  Pixels that no frame can take travel in
    ``beside`` with a reason: ``outside`` its cells, ``repeated`` (a cell keeps its first value), ``late`` (its frame has
    left); :func:`beside_table` lists them.  Needs :func:`use_list_store`.
    """
    return pixels.select("datum", "frame", "y", "x", "v").groupBy("datum", "frame").transformWithStateInPandas(
        FrameCompletion(height, width), COMPLETED, "append", "none")


def completed(rows: DataFrame) -> DataFrame:
    """Frames among the rows of :func:`complete_frames`."""
    return rows.where("pixels IS NOT NULL").drop("beside")


def beside_table(rows: DataFrame) -> DataFrame:
    """The pixels that no frame took, one row each: datum, frame, y, x, v, reason."""
    return rows.select("datum", "frame", F.inline("beside"))
