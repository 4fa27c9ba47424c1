"""From video to traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotrace.model import FRAME_SIDE
from spotrace.operators.images import (
    box_intensity_frames,
    find_maxima,
    grow_boxes,
    pack_frames,
    renumber_kept,
    rescale_16bit,
    subtract_background,
    unpack_frames,
    z_project_frames,
)
from spotrace.operators.labels import with_recording
from spotrace.session import materialize


def clean_frames(frames: DataFrame, manifest: DataFrame | None, background: str | None) -> DataFrame:
    """Frames after background removal with the radius of their recording."""
    if background is None:
        return frames
    if background != "per_frame":
        raise ValueError("background is None or 'per_frame'")
    return subtract_background(with_recording(frames, manifest, "rolling_radius"), "rolling_radius").drop("rolling_radius")


def photobleaching_image(
    frames: DataFrame, manifest: DataFrame, stop: int, background: bool = True, height: int = FRAME_SIDE, width: int = FRAME_SIDE
) -> DataFrame:
    """The image in which fading particles are sought: the maximum of the first ``stop`` frames, rescaled.

    Background goes after the projection here, once per recording.
    """
    projected = materialize(z_project_frames(frames, method="max", stop=stop), "projected")
    if background:
        still = pack_frames(projected.withColumn("frame", F.lit(1)), height, width)
        projected = unpack_frames(clean_frames(still, manifest, "per_frame")).drop("frame")
    return rescale_16bit(materialize(projected, "cleaned"))


def segment(
    frames: DataFrame,
    manifest: DataFrame,
    background: str | None = "per_frame",
    height: int = FRAME_SIDE,
    width: int = FRAME_SIDE,
) -> tuple[DataFrame, DataFrame]:
    """Boxes of every recording (kept ones numbered) and the frames they were found in.

    Boxes are stored once: the peak search is per recording and must not be
    repeated for every consumer.
    """
    # Cleaned frames are read again for the traces, the image by several steps: each is made once.
    cleaned = frames if background is None else materialize(clean_frames(frames, manifest, background), "cleaned")
    image = materialize(rescale_16bit(materialize(z_project_frames(cleaned), "projected")), "image")
    peaks = find_maxima(with_recording(image, manifest, "peak_prominence"), F.col("peak_prominence"))
    grown = grow_boxes(
        image, with_recording(peaks, manifest, "profile_tolerance"), F.col("profile_tolerance"), height, width
    )
    boxes = materialize(grown, "boxes")
    kept = renumber_kept(boxes).select("datum", "box_num", "trace_num")
    return boxes.join(kept, ["datum", "box_num"], "left"), cleaned


def extract_traces(
    frames: DataFrame,
    manifest: DataFrame,
    background: str | None = "per_frame",
    height: int = FRAME_SIDE,
    width: int = FRAME_SIDE,
) -> DataFrame:
    """The image stage: samples of every kept box of every recording."""
    boxes, cleaned = segment(frames, manifest, background, height, width)
    return box_intensity_frames(cleaned, boxes.filter("is_kept"))


def segmentation_grid(
    frames: DataFrame,
    grid: Sequence[tuple[int, float, float]],
    height: int = FRAME_SIDE,
    width: int = FRAME_SIDE,
) -> DataFrame:
    """Kept and rejected box counts for trial parameters (radius, prominence, tolerance).

    Frames are cleaned and projected once per radius; the trials are rows.
    """
    trials = F.array(*[
        F.struct(F.lit(int(r)).alias("radius"), F.lit(float(p)).alias("prominence"), F.lit(float(t)).alias("tolerance"))
        for r, p, t in grid
    ])
    radii = F.array(*[F.lit(r) for r in sorted({int(r) for r, _, _ in grid})])
    per_radius = subtract_background(frames.withColumn("radius", F.explode(radii)), "radius")
    by_radius = ["datum", "radius"]
    projected = materialize(z_project_frames(per_radius, by_radius), "projected")
    image = materialize(rescale_16bit(projected, by_radius), "image")
    tried = image.withColumn(
        "trial", F.explode(F.filter(trials, lambda t: t["radius"] == F.col("radius")))
    ).select("datum", "radius", "trial.prominence", "trial.tolerance", "y", "x", "v")
    keys = ["datum", "radius", "prominence", "tolerance"]
    peaks = find_maxima(tried, F.col("prominence"), keys)
    renamed = peaks.withColumnRenamed("tolerance", "trial_tolerance")
    image_keys = ["datum", "radius", "prominence", "trial_tolerance"]
    grown = grow_boxes(
        tried.withColumnRenamed("tolerance", "trial_tolerance"), renamed, F.col("trial_tolerance"),
        height, width, image_keys,
    )
    return grown.groupBy(*image_keys).agg(
        F.count_if("is_kept").alias("n_kept"), F.count_if(~F.col("is_kept")).alias("n_rejected")
    ).withColumnRenamed("trial_tolerance", "tolerance")


def frames_of(pixels: DataFrame, height: int = FRAME_SIDE, width: int = FRAME_SIDE) -> DataFrame:
    """Packed frames of a pixel table."""
    return pack_frames(pixels, height, width)
