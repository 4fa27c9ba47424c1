"""Image operators on pixel tables: projection, background, peaks, boxes, intensities.

``pixels(datum, frame, y, x, v)`` is the relational form and ``frames(datum,
frame, height, width, pixels)`` the packed one, with a frame as one array in
row order.  A frame has a fixed, bounded size, so per-frame numpy code works on
bounded groups.  Projections are cut into tiles with a border, so that one
recording keeps many tasks busy; everything else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.model import DEFAULT_ROLLING_RADIUS, FRAME_SIDE
from spotrace.session import is_small

# Fixed values of the box growth: accepted boxes stopped at steps 2..11, and no
# box is examined beyond step 13.
LEAST_STEPS = 2
MOST_STEPS = 11
LAST_STEP = 13

# Partial images a task holds before it hands them on (8 MB each at full size).
HELD_IMAGES = 16
# Side of the square tiles that projections are cut into.
TILE = 256
# Parts that the frames of a recording are dealt to where its boxes are not broadcast.
FRAME_PARTS = 32
# Boxes are broadcast up to this many rows.
BROADCAST_BOXES = 200_000
BROADCAST_CELL_BOXES = 2_000

DATUM = ("datum",)


def unpack_frames(frames: DataFrame, keys: Sequence[str] = DATUM) -> DataFrame:
    """Packed frames to one row per pixel."""
    return frames.select(*keys, "frame", "width", F.posexplode("pixels").alias("pos", "v")).select(
        *keys, "frame",
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        (F.col("pos") % F.col("width")).alias("x"),
        F.col("v").cast("double").alias("v"),
    )


def pack_frames(
    pixels: DataFrame, height: int = FRAME_SIDE, width: int = FRAME_SIDE, keys: Sequence[str] = DATUM
) -> DataFrame:
    """One array per frame in row order; a group is one frame and thus bounded.

    A frame whose pixels are not exactly the cells of height by width is an error.
    """
    cell = F.struct((F.col("y") * width + F.col("x")).alias("pos"), F.col("v"))
    return pixels.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(
        *keys, "frame", F.lit(height).alias("height"), F.lit(width).alias("width"),
        F.when(
            F.col("cells.pos") == F.sequence(F.lit(0), F.lit(height * width - 1)).cast("array<int>"), F.col("cells.v")
        ).otherwise(F.raise_error(F.concat(F.lit("incomplete frame "), F.col("frame").cast("string")))).alias("pixels"),
    )


def _ball(radius: int) -> list[tuple[int, int, float]]:
    span = range(-radius, radius + 1)
    return [
        (dy, dx, float(np.sqrt(radius * radius - dy * dy - dx * dx)))
        for dy in span for dx in span if dy * dy + dx * dx <= radius * radius
    ]


def remove_background(image: np.ndarray, radius: int) -> np.ndarray:
    """Subtract the surface a ball of this radius reaches when rolled under the image.

    The ball is lowered onto the image (minimum over its footprint) and its top
    traces the background (maximum over the footprint).  Neighbours outside the
    image do not count.
    """
    h, w = image.shape
    ball = _ball(radius)
    padded = np.pad(image, radius, constant_values=np.inf)
    floor = np.full((h, w), np.inf)
    for dy, dx, z in ball:
        np.minimum(floor, padded[radius + dy:radius + dy + h, radius + dx:radius + dx + w] - z, out=floor)
    padded = np.pad(floor, radius, constant_values=-np.inf)
    surface = np.full((h, w), -np.inf)
    for dy, dx, z in ball:
        np.maximum(surface, padded[radius - dy:radius - dy + h, radius - dx:radius - dx + w] + z, out=surface)
    return image - surface


def subtract_background(
    frames: DataFrame, radius: int | str = DEFAULT_ROLLING_RADIUS
) -> DataFrame:
    """Rolling-ball background removal, frame by frame in Arrow batches, without a shuffle.

    ``radius`` is a number or the name of a column with one.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def cleaned(pixels: pd.Series, height: pd.Series, width: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([
            remove_background(np.asarray(p, dtype=float).reshape(int(h), int(w)), int(k)).ravel()
            for p, h, w, k in zip(pixels, height, width, r)
        ])

    size = F.col(radius) if isinstance(radius, str) else F.lit(radius)
    return frames.withColumn("pixels", cleaned("pixels", "height", "width", size))


def z_project(
    pixels: DataFrame, method: str = "sum", stop: int | None = None, keys: Sequence[str] = DATUM
) -> DataFrame:
    """Collapse frames per pixel: ``sum``, or ``max`` of the first ``stop`` frames."""
    if stop is not None:
        pixels = pixels.filter(F.col("frame") <= stop)
    combine = {"sum": F.sum, "max": F.max}[method]
    return pixels.groupBy(*keys, "y", "x").agg(combine("v").alias("v"))


def z_project_frames(
    frames: DataFrame, keys: Sequence[str] = DATUM, method: str = "sum", stop: int | None = None
) -> DataFrame:
    """Projection of packed frames, one row per pixel: ``sum``, or ``max`` of the first ``stop`` frames.

    Each task combines the frames it reads as arrays and hands on one partial
    image per recording, so the shuffle carries images, not frames.
    """
    keys = list(keys)
    if stop is not None:
        frames = frames.filter(F.col("frame") <= stop)
    combine, arrays = {"sum": (F.sum, np.add), "max": (F.max, np.maximum)}[method]
    fields = [frames.schema[k] for k in keys] + [frames.schema["width"]]
    partial = T.StructType([*fields, T.StructField("pixels", T.ArrayType(T.DoubleType()))])

    def add_up(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for row in zip(*[pdf[c] for c in (*keys, "width", "pixels")]):
                image = np.asarray(row[-1], dtype=float)
                held = sums.get(row[:-1])
                sums[row[:-1]] = image.copy() if held is None else arrays(held, image)
            if len(sums) > HELD_IMAGES:
                yield _image_rows(sums, partial)
                sums = {}
        if sums:
            yield _image_rows(sums, partial)

    images = frames.select(*keys, "width", "pixels").mapInPandas(add_up, partial)
    return images.select(*keys, "width", F.posexplode("pixels").alias("pos", "v")).groupBy(
        *keys, F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        (F.col("pos") % F.col("width")).alias("x"),
    ).agg(combine("v").alias("v"))


def _image_rows(sums: dict[tuple, np.ndarray], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(list(sums), columns=schema.names[:-1])
    out[schema.names[-1]] = list(sums.values())
    return out


def region_intensity_frames(frames: DataFrame, side: int = FRAME_SIDE) -> DataFrame:
    """Quadrant sums of packed frames, without a shuffle."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def quadrants(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        half = side // 2
        spans = (slice(0, half), slice(half, side))
        sums = []
        for p, h, w in zip(pixels, height, width):
            image = np.asarray(p, dtype=float).reshape(int(h), int(w))
            sums.append([float(image[ys, xs].sum()) for xs in spans for ys in spans])
        return pd.Series(sums)

    summed = frames.select("datum", "frame", quadrants("pixels", "height", "width").alias("q"))
    return summed.select("datum", "frame", F.posexplode("q").alias("pos", "raw")).select(
        "datum", (F.col("pos") + 1).alias("region"), "frame", "raw"
    )


def rescale_16bit(image: DataFrame, keys: Sequence[str] = DATUM) -> DataFrame:
    """Linear rescale of each projection to the integers 0..65535."""
    spans = image.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.expr("coalesce(try_divide((v - lo) * 65535, hi - lo), 0)")
    return image.join(spans, list(keys)).select(
        *keys, "y", "x", F.floor(scaled + 0.5).cast("int").alias("v")
    )


def region_of(
    y: Column, x: Column, split: int = FRAME_SIDE // 2
) -> Column:
    """1 top-left, 2 bottom-left, 3 top-right, 4 bottom-right."""
    return (1 + F.floor(y / split) + 2 * F.floor(x / split)).cast("int")


def region_intensity(pixels: DataFrame, side: int = FRAME_SIDE) -> DataFrame:
    """Sum of each quadrant in each frame; pixels beyond the frame side do not count."""
    inside = F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)
    region = region_of(F.col("y"), F.col("x"), side // 2).alias("region")
    return pixels.filter(inside).groupBy("datum", region, "frame").agg(F.sum("v").alias("raw"))


def _cells(boxes: DataFrame, *columns: str) -> DataFrame:
    """One row per pixel of every box (at most 27 x 27)."""
    reach = F.sequence(F.lit(0), F.col("width") - 1)
    return (
        boxes.select(*columns, "x0", "y0", "width", F.explode(reach).alias("dy"))
        .withColumn("dx", F.explode(reach))
        .select(*columns, "width", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))
    )


def box_intensity(
    pixels: DataFrame, boxes: DataFrame, max_broadcast_boxes: int = BROADCAST_CELL_BOXES
) -> DataFrame:
    """Trace samples: mean column profile times box length, per box and frame.

    Boxes become cells and meet the pixels in an equi-join.  A box table that
    is proven small is broadcast, and the pixels are not shuffled before the
    partial sums; a larger one takes the shuffle join on (datum, y, x), which
    spreads even one huge recording over its pixel positions.
    """
    cells = _cells(boxes, "datum", "trace_num")
    if is_small(boxes, max_broadcast_boxes):
        cells = F.broadcast(cells)  # at most 27 x 27 cells per box
    return (
        pixels.join(cells, ["datum", "y", "x"])
        .groupBy("datum", "trace_num", "frame")
        .agg((F.sum("v") / F.max("width")).alias("raw"))
    )


def summed_area(image: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and to the left: one row and one column larger than the image."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, 0), 1, out=out[1:, 1:])
    return out


def box_sums(image: np.ndarray, x0: np.ndarray, y0: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sum over the part of each square box inside the image, by four look-ups; NaN without any."""
    area = summed_area(image)
    top, left = np.maximum(y0, 0), np.maximum(x0, 0)
    bottom, right = np.minimum(y0 + width, image.shape[0]), np.minimum(x0 + width, image.shape[1])
    inside = (top < bottom) & (left < right)
    t, b, l, r = (np.where(inside, c, 0) for c in (top, bottom, left, right))
    return np.where(inside, area[b, r] - area[t, r] - area[b, l] + area[t, l], np.nan)


_MEASURED = T.ArrayType(T.StructType([T.StructField("trace_num", T.IntegerType()), T.StructField("raw", T.DoubleType())]))


@F.pandas_udf(_MEASURED)
def _measured(frame: pd.DataFrame, boxes: pd.Series) -> pd.Series:
    out = []
    for pixels, height, width, found in zip(frame["pixels"], frame["height"], frame["width"], boxes):
        image = np.asarray(pixels, dtype=float).reshape(int(height), int(width))
        x0, y0, side = (np.array([b[c] for b in found], np.int64) for c in ("x0", "y0", "width"))
        raw = box_sums(image, x0, y0, side) / side
        out.append([{"trace_num": b["trace_num"], "raw": r} for b, r in zip(found, raw.tolist()) if r == r])
    return pd.Series(out)


def box_intensity_frames(
    frames: DataFrame, boxes: DataFrame, max_broadcast_boxes: int = BROADCAST_BOXES
) -> DataFrame:
    """The same from packed frames: each frame sums its boxes in place, each box by four look-ups.

    Boxes of a recording travel as one array (bounded by the pixels of a frame);
    frames never leave their partition when the box table is small.  Beyond that they are
    dealt by recording and frame number, so that a long recording is no single task.
    """
    box = F.struct("trace_num", "x0", "y0", "width")
    lists = boxes.groupBy("datum").agg(F.collect_list(box).alias("boxes"))
    if is_small(boxes, max_broadcast_boxes):
        met = frames.join(F.broadcast(lists), "datum")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(FRAME_PARTS - 1)))
        dealt = frames.withColumn("part", F.pmod("frame", F.lit(FRAME_PARTS)))
        met = dealt.join(lists.withColumn("part", parts), ["datum", "part"])
    measured = _measured(F.struct("pixels", "height", "width"), F.col("boxes"))
    return met.select("datum", "frame", F.explode(measured).alias("m")).select(
        "datum", "m.trace_num", "frame", "m.raw")


def column_profile(image: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean, minimum and maximum of every column of every box."""
    cells = _cells(boxes, "datum", "box_num")
    return image.join(cells, ["datum", "y", "x"]).groupBy("datum", "box_num", "x").agg(
        F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )


def prominent_peaks(y: np.ndarray, x: np.ndarray, v: np.ndarray, prominence: np.ndarray) -> np.ndarray:
    """Indices of maxima that stand ``prominence`` above the saddle to anything higher.

    Every pixel climbs to its highest neighbour until it reaches a summit; two
    hills meet at the brightest pair of touching pixels.  Meetings are taken
    from the brightest down and settle the lower summit: it is a peak if they
    lie at least ``prominence`` below it.  Equal pixels rank by position.
    """
    order = np.lexsort((x, y, -v))
    count = len(order)
    level = np.full((int(y.max()) + 3, int(x.max()) + 3), count)
    level[y[order] + 1, x[order] + 1] = np.arange(count)  # 0 is the brightest

    rows, cols = slice(1, -1), slice(1, -1)
    highest = level[rows, cols].copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            near = np.roll(level, (dy, dx), (0, 1))[rows, cols]
            np.minimum(highest, near, out=highest)
    hill = highest[y[order], x[order]]
    while not np.array_equal(hill, up := hill[hill]):
        hill = up

    pairs, meetings = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        here, there = level[rows, cols], np.roll(level, (-dy, -dx), (0, 1))[rows, cols]
        both = (here < count) & (there < count)
        one, two = here[both], there[both]
        differ = hill[one] != hill[two]
        one, two = one[differ], two[differ]
        low, high = np.maximum(hill[one], hill[two]), np.minimum(hill[one], hill[two])
        pairs.append(low.astype(np.int64) * count + high)
        meetings.append(np.maximum(one, two))
    pair, meeting = np.concatenate(pairs), np.concatenate(meetings)
    by_pair = np.lexsort((meeting, pair))
    first = by_pair[np.r_[True, np.diff(pair[by_pair]) > 0]] if len(pair) else by_pair
    first = first[np.argsort(meeting[first], kind="stable")]

    summits = np.unique(hill)
    kept = _stand_out(
        v[order[summits]], prominence[order[summits]],
        np.searchsorted(summits, pair[first] // count), np.searchsorted(summits, pair[first] % count), v[order[meeting[first]]],
    )
    return np.sort(order[summits[kept]])


def _stand_out(
    height: np.ndarray, needed: np.ndarray, low: np.ndarray, high: np.ndarray, meeting: np.ndarray
) -> np.ndarray:
    """Which summits, numbered from the brightest, lie ``needed`` above the saddle to anything higher.

    Pairs of hills and the brightness where they meet come from the brightest meeting down.
    """
    summit = list(range(len(height)))

    def root(h: int) -> int:
        while summit[h] != h:
            summit[h] = summit[summit[h]]
            h = summit[h]
        return h

    peaks = []
    for one, two, at in zip(low.tolist(), high.tolist(), meeting.tolist()):
        a, b = sorted((root(one), root(two)))
        if a == b:
            continue
        if height[b] - at >= needed[b]:
            peaks.append(b)
        summit[b] = a
    peaks.extend(h for h, top in enumerate(summit) if h == top)
    return np.asarray(sorted(peaks), dtype=np.int64)


# What a tile says of its part of an image: summits, where its border pixels climb to, where hills meet.
SUMMIT, FLOW, MEETING = 0, 1, 2
_HILLS = [
    T.StructField("kind", T.IntegerType()),
    *(T.StructField(c, T.LongType()) for c in ("a", "b", "at")),  # pixels, as y * 2**32 + x
    T.StructField("v", T.DoubleType()), T.StructField("level", T.DoubleType()),
]


def _pixel(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (y.astype(np.int64) << 32) | x.astype(np.int64)


def tile_hills(y: np.ndarray, x: np.ndarray, v: np.ndarray, level: np.ndarray, home: np.ndarray) -> pd.DataFrame:
    """Summits, flows and meetings of one tile, whose pixels come with a border of one pixel around (not ``home``).

    Every home pixel climbs to its highest neighbour until it reaches a summit or leaves the tile; the border
    pixel there says in its own tile where it climbs on.  Of all meetings of two hills the brightest is kept.
    """
    order = np.lexsort((x, y, -v))
    y, x, v, level, home = y[order], x[order], v[order], level[order], home[order]
    count, none = len(order), len(order)
    rank = np.full((int(y.max() - y.min()) + 3, int(x.max() - x.min()) + 3), none)
    rows, cols = y - y.min() + 1, x - x.min() + 1
    rank[rows, cols] = np.arange(count)  # 0 is the brightest
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    highest = np.minimum.reduce([rank[rows + dy, cols + dx] for dy, dx in steps])
    hill = np.where(home, highest, np.arange(count))
    while not np.array_equal(hill, up := hill[hill]):
        hill = up
    pixel = _pixel(y, x)
    tops = np.flatnonzero(home & (hill == np.arange(count)))
    # Home pixels that a neighbouring tile may see: those beside a pixel that is not home, or beside nothing.
    near = [rank[rows + dy, cols + dx] for dy, dx in steps]
    at_edge = home & np.logical_or.reduce([(n < none) & ~np.append(home, True)[n] for n in near])
    one, two = [], []
    for dy, dx in steps:
        other = rank[rows + dy, cols + dx]
        here = np.flatnonzero(home & (other < none))
        there = other[here]
        apart = hill[here] != hill[there]
        one.append(here[apart])
        two.append(there[apart])
    here, there = np.concatenate(one), np.concatenate(two)
    low, high = np.maximum(hill[here], hill[there]), np.minimum(hill[here], hill[there])
    pair, meeting = low.astype(np.int64) * count + high, np.maximum(here, there)
    by_pair = np.lexsort((meeting, pair))
    first = by_pair[np.r_[True, np.diff(pair[by_pair]) > 0]] if len(pair) else by_pair
    edge = np.flatnonzero(at_edge)
    parts = [
        (SUMMIT, pixel[tops], pixel[tops], pixel[tops], v[tops], level[tops]),
        (FLOW, pixel[edge], pixel[hill[edge]], pixel[edge], v[edge], level[edge]),
        (MEETING, pixel[low[first]], pixel[high[first]], pixel[meeting[first]], v[meeting[first]], level[meeting[first]]),
    ]
    names = [f.name for f in _HILLS]
    return pd.concat([pd.DataFrame(dict(zip(names, p))) for p in parts], ignore_index=True)


def joined_peaks(hills: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, v) in raster order of the peaks of one image from what its tiles say."""
    tops = hills[hills["kind"] == SUMMIT].sort_values(["v", "a"], ascending=[False, True], ignore_index=True)
    flow = hills[hills["kind"] == FLOW].sort_values("a", ignore_index=True)
    meet = hills[hills["kind"] == MEETING]
    source, target = flow["a"].to_numpy(), flow["b"].to_numpy()

    def climbed(pixel: np.ndarray) -> np.ndarray:
        while len(source):
            at = np.minimum(np.searchsorted(source, pixel), len(source) - 1)
            on = np.where(source[at] == pixel, target[at], pixel)
            if np.array_equal(on, pixel):
                break
            pixel = on
        return pixel

    by_pixel = np.argsort(tops["a"].to_numpy())
    ranked = tops["a"].to_numpy()[by_pixel]
    one, two = (by_pixel[np.searchsorted(ranked, climbed(meet[c].to_numpy()))] for c in ("a", "b"))
    low, high = np.maximum(one, two), np.minimum(one, two)
    order = np.lexsort((meet["at"].to_numpy(), -meet["v"].to_numpy()))
    order = order[(low != high)[order]]
    kept = _stand_out(tops["v"].to_numpy(), tops["level"].to_numpy(), low[order], high[order], meet["v"].to_numpy()[order])
    chosen = tops.iloc[kept].sort_values("a")
    pixel = chosen["a"].to_numpy()
    return pixel >> 32, pixel & 0xFFFFFFFF, chosen["v"].to_numpy()


def _tiled(rows: DataFrame, tile: int, border: int) -> DataFrame:
    """Pixel rows with ``ty, tx``; pixels within ``border`` of another tile come to it too."""
    for name, at in (("ty", F.col("y")), ("tx", F.col("x"))):
        first = F.greatest(F.floor((at - border) / tile), F.lit(0)).cast("int")
        rows = rows.withColumn(name, F.explode(F.sequence(first, F.floor((at + border) / tile).cast("int"))))
    return rows


def find_maxima(
    image: DataFrame, prominence: Column | float, keys: Sequence[str] = DATUM, tile: int = TILE
) -> DataFrame:
    """Peaks of each projected image, numbered in raster order: ``box_num, cx, cy, v``.

    Pixels are flooded tile by tile; only summits, border pixels and the places where hills meet come
    together for an image, whose hills are then joined from the brightest meeting down.
    """
    keys = list(keys)
    level = prominence if isinstance(prominence, Column) else F.lit(float(prominence))
    sized = image.select(
        *keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        F.col("v").cast("double").alias("v"), level.cast("double").alias("_level"))
    fields = [sized.schema[k] for k in keys]

    def with_keys(pdf: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, v, at = (pdf[c].to_numpy() for c in ("y", "x", "v", "_level"))
        home = (y // tile == pdf["ty"].iloc[0]) & (x // tile == pdf["tx"].iloc[0])
        return with_keys(pdf, tile_hills(y, x, v, at, home))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, v = joined_peaks(pdf)
        return with_keys(pdf, pd.DataFrame({"box_num": np.arange(1, len(y) + 1), "cx": x, "cy": y, "v": v}))

    hills = _tiled(sized, tile, 1).groupBy(*keys, "ty", "tx").applyInPandas(flood, T.StructType([*fields, *_HILLS]))
    peaks = T.StructType([
        *fields, *(T.StructField(c, T.IntegerType()) for c in ("box_num", "cx", "cy")), T.StructField("v", T.DoubleType())])
    return hills.groupBy(*keys).applyInPandas(join, peaks)


def peak_stats(image: DataFrame, peaks: DataFrame) -> DataFrame:
    """Measurement table of the peaks: minimum, maximum and corner (a peak is one pixel)."""
    at = peaks.select("datum", "box_num", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return image.join(at, ["datum", "y", "x"]).select(
        "datum", "box_num", F.col("v").alias("min"), F.col("v").alias("max"),
        F.col("x").alias("bx"), F.col("y").alias("by"),
    )


def particle_stats(boxes: DataFrame) -> DataFrame:
    """Measurement table of the boxes: area and bounding rectangle."""
    return boxes.select(
        "datum", "box_num", (F.col("width") * F.col("width")).alias("area"),
        F.col("x0").alias("bx"), F.col("y0").alias("by"), "width", F.col("width").alias("height"),
    )


def grow_boxes(
    image: DataFrame,
    peaks: DataFrame,
    tolerance: Column | float,
    height: int = FRAME_SIDE,
    width: int = FRAME_SIDE,
    keys: Sequence[str] = DATUM,
) -> DataFrame:
    """Grow a square box on every peak until its mean column profile stops falling outwards.

    Result: ``box_num, cx, cy, x0, y0, width, steps, is_kept``.  Peaks meet the tile of the image around
    them, where column prefix sums give the profiles of all 13 steps, each mean by two look-ups.
    """
    level = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    keys = list(keys)
    ident = [*keys, "box_num", "cx", "cy", "tolerance"]
    seeds = peaks.select(*[c for c in ident if c != "tolerance"], level.cast("double").alias("tolerance"))
    pixels = _tiled(image.select(*keys, "y", "x", F.col("v").cast("double").alias("v")), TILE, LAST_STEP)
    placed = seeds.withColumn("ty", F.floor(F.col("cy") / TILE).cast("int")).withColumn("tx", F.floor(F.col("cx") / TILE).cast("int"))
    stops_of = T.StructType([
        *(seeds.schema[c] for c in ident), T.StructField("profile_stop", T.IntegerType()),
        T.StructField("whole", T.ArrayType(T.BooleanType())),
    ])

    def profiled(found: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(pdf):
            return pd.DataFrame(columns=stops_of.names)
        stop, whole = growth_stops(*(pdf[c].to_numpy() for c in ("y", "x", "v")), *(found[c].to_numpy() for c in ("cy", "cx", "tolerance")))
        return found[ident].assign(profile_stop=stop, whole=list(whole))

    at = [*keys, "ty", "tx"]
    stops = placed.groupBy(*at).cogroup(pixels.groupBy(*at)).applyInPandas(profiled, stops_of)
    edge_stop = F.least("cx", "cy", F.lit(width + 1) - F.col("cx"), F.lit(height + 1) - F.col("cy")) + 1
    grown = stops.withColumn("edge_stop", edge_stop).withColumn(
        "steps", F.least("edge_stop", "profile_stop")
    ).withColumn(
        # At the image edge the box of the step before stays.
        "half", F.when(F.col("edge_stop") <= F.col("profile_stop"), F.col("steps") - 1).otherwise(F.col("steps"))
    )
    whole = F.coalesce(F.try_element_at("whole", F.nullif(F.col("half"), F.lit(0))), F.lit(True))
    return grown.select(
        *keys, "box_num", "cx", "cy",
        (F.col("cx") - F.col("half")).alias("x0"), (F.col("cy") - F.col("half")).alias("y0"),
        (2 * F.col("half") + 1).alias("width"), "steps",
        (valid_box(F.col("steps")) & whole).alias("is_kept"),
    )


def growth_stops(
    y: np.ndarray, x: np.ndarray, v: np.ndarray, cy: np.ndarray, cx: np.ndarray, tolerance: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(the step at which each peak's profile stops it, whether every column of each step has pixels).

    Means are over the pixels that exist; a column wholly outside has no mean and fails no test.
    """
    top, left, reach = min(y.min(), cy.min() - LAST_STEP), min(x.min(), cx.min() - LAST_STEP), LAST_STEP
    shape = (max(y.max(), cy.max() + reach) - top + 2, max(x.max(), cx.max() + reach) - left + 1)
    total, present = np.zeros(shape), np.zeros(shape, np.int64)
    total[y - top + 1, x - left], present[y - top + 1, x - left] = v, 1
    total, present = np.cumsum(total, 0), np.cumsum(present, 0)
    stop = np.full(len(cy), reach, np.int32)
    whole = np.zeros((len(cy), reach), bool)
    open_yet = np.ones(len(cy), bool)
    for j in range(1, reach + 1):
        columns = (cx - left)[:, None] + np.arange(-j, j + 1)
        low, high = (cy - top - j)[:, None], (cy - top + j + 1)[:, None]
        n = present[high, columns] - present[low, columns]
        means = np.where(n > 0, (total[high, columns] - total[low, columns]) / np.maximum(n, 1), np.nan)
        whole[:, j - 1] = (n > 0).all(1)
        least = np.fmax.reduce(means, axis=1) * tolerance
        first, second, last, second_last = means[:, 0], means[:, 1], means[:, -1], means[:, -2]
        failed = (first < least) | (last < least) | (first >= second) | (last >= second_last)
        stop[open_yet & failed] = j
        open_yet &= ~failed
    return stop, whole


def valid_box(steps: Column) -> Column:
    """Whether growth stopped within the accepted range of steps."""
    return steps.between(LEAST_STEPS, MOST_STEPS)


def renumber_kept(boxes: DataFrame, keys: Sequence[str] = DATUM) -> DataFrame:
    """Drop rejected boxes and number the kept ones 1..K as traces, in box order.

    A recording has fewer boxes than a frame has pixels, which bounds the window.
    """
    w = Window.partitionBy(*keys).orderBy("box_num")
    return boxes.filter("is_kept").withColumn("trace_num", F.row_number().over(w))
