"""From traces to dwell-time statistics, by automatic or by manual labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spotrace.model import TRACE_KEYS
from spotrace.operators.changepoints import find_changepoints
from spotrace.operators.events import auto_status, dwell_times, fold_actions, reload_status
from spotrace.operators.images import region_intensity_frames
from spotrace.operators.stats import fit_summary
from spotrace.session import materialize


def automatic_events(
    samples: DataFrame, frames: DataFrame | None, manifest: DataFrame, side: int, regions: DataFrame | None = None, **search
) -> tuple[DataFrame, DataFrame]:
    """Changepoints and automatic labels; ``regions``, unless given, come from the unfiltered video."""
    if frames is not None and regions is None:
        regions = materialize(region_intensity_frames(frames, side), "regions")
    found = materialize(find_changepoints(samples, regions, manifest, **search), "changepoints")
    traces = samples.select(*TRACE_KEYS).distinct()
    return found, auto_status(found, traces, manifest)


def automatic_statistics(
    samples: DataFrame, frames: DataFrame | None, manifest: DataFrame, side: int, **search
) -> DataFrame:
    """Changepoints, labels, dwell times and the fit of every recording."""
    _, status = automatic_events(samples, frames, manifest, side, **search)
    return fit_summary(dwell_times(status, manifest), manifest)


def manual_statistics(actions: DataFrame, manifest: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Folded review actions, saved and reloaded, to the fit of every recording."""
    status = reload_status(fold_actions(actions, manifest, traces))
    return fit_summary(dwell_times(status, manifest), manifest)
