"""Automatic runs that leave a record.

Each run writes its results by recording into folders of its own.  They count once a marker row names the
run for the recording; the marker is written last, as one file, so that a run that is lost on the way leaves nothing
that anyone reads, and the next run does its recordings again.  Recordings with a marker are skipped.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotrace.operators.events import dwell_times
from spotrace.operators.stats import fit_summary
from spotrace.plans.analysis import automatic_events
from spotrace.session import broadcast_if_small, materialize, release
from spotrace.sources.tables import output_path, pending_datums

MARKERS = "datum int, run string, finished_at timestamp"
KINDS = ("changepoints", "detections", "dwell_times", "fits")


def _folder(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/Fits" if kind == "fits" else output_path(root, kind)


def _markers(root: str) -> str:
    return f"{root.rstrip('/')}/_runs"


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(datum, run): the latest finished run of each recording."""
    try:
        rows = spark.read.schema(MARKERS).parquet(_markers(root))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MARKERS)
    return rows.groupBy("datum").agg(F.max_by("run", F.struct("finished_at", "run")).alias("run"))


def mark_finished(manifest: DataFrame, root: str, run: str) -> None:
    """Say that a run has written all results of these recordings; one file, so all of them or none."""
    rows = manifest.select(F.col("datum").cast("int"), F.lit(run).alias("run"), F.current_timestamp().alias("finished_at"))
    rows.coalesce(1).write.mode("append").parquet(_markers(root))


def read_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Rows of one kind of result, for every recording from its latest finished run."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    marked = broadcast_if_small(finished(spark, root))
    rows = spark.read.parquet(_folder(root, kind))
    return rows.join(marked, ["datum", "run"], "left_semi").drop("run")


def _write(df: DataFrame, root: str, kind: str, run: str) -> None:
    # Empty results leave a file with the schema too, so that a kind without rows can be read.
    df.write.mode("overwrite").parquet(f"{_folder(root, kind)}/run={run}")


def run_automatic(
    spark: SparkSession, root: str, samples: DataFrame, frames: DataFrame | None, manifest: DataFrame, side: int, **search
) -> str | None:
    """Search, label, measure and fit the recordings that have no results under ``root`` yet.

    Returns the run's name, or None if nothing was left to do.  Results: ``changepoints``, ``detections`` (automatic
    labels), ``dwell_times`` and ``fits``, see :func:`read_results`.
    """
    todo = materialize(pending_datums(manifest, finished(spark, root)), "pending")
    if todo.isEmpty():
        release(todo)
        return None
    run = uuid.uuid4().hex
    only = broadcast_if_small(todo.select("datum"))
    mine = samples.join(only, "datum", "left_semi")
    video = None if frames is None else frames.join(only, "datum", "left_semi")
    if search.get("regions") is not None:
        search = {**search, "regions": search["regions"].join(only, "datum", "left_semi")}
    found, status = automatic_events(mine, video, todo, side, **search)
    status = materialize(status, "status")
    _write(found, root, "changepoints", run)
    _write(status, root, "detections", run)
    _write(dwell_times(status, todo), root, "dwell_times", run)
    _write(fit_summary(dwell_times(status, todo), todo), root, "fits", run)
    mark_finished(todo, root, run)
    release(found, status, todo)
    return run
