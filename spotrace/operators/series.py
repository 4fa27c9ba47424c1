"""Per-trace series operators: normalisation, gradient, decomposition, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spotrace.functions.chunks import (
    CHUNK_BITS,
    attach_stats,
    chunk_of,
    chunk_window,
    series_stats,
    with_chunk,
    with_halo,
)
from spotrace.model import SEASON_PERIOD, TRACE_KEYS


def trace_stats(samples: DataFrame, keys: Sequence[str] = TRACE_KEYS) -> DataFrame:
    """Length, minimum, maximum, mean and population deviation of every trace."""
    return samples.groupBy(*keys).agg(
        F.count("raw").cast("int").alias("n"),
        F.min("raw").alias("lo"),
        F.max("raw").alias("hi"),
        F.avg("raw").alias("mean"),
        F.stddev_pop("raw").alias("std_pop"),
    )


def normalize(
    samples: DataFrame,
    method: str = "minmax",
    keys: Sequence[str] = TRACE_KEYS,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add ``norm``.

    ``minmax`` maps a trace onto 0..1, ``zscore`` standardises with the
    population deviation and ``zscore_compat`` subtracts mean/deviation, the
    form existing results were made with.  A constant trace gets NULL.
    """
    stats = series_stats(samples, keys, bits=chunk_bits)
    joined = attach_stats(with_chunk(samples, chunk_bits), stats, keys)
    forms = {
        "minmax": "try_divide(raw - lo, hi - lo)",
        "zscore": "try_divide(raw - mean, std_pop)",
        "zscore_compat": "raw - try_divide(mean, std_pop)",
    }
    if method not in forms:
        raise ValueError(f"unknown normalisation {method!r}; choose from {sorted(forms)}")
    return joined.select(*samples.columns, F.expr(forms[method]).alias("norm"))


def gradient_of(value: Column | str, w: WindowSpec) -> Column:
    """Central difference, one-sided at the two ends, NULL for a single sample."""
    value = F.col(value) if isinstance(value, str) else value
    after, ahead = F.lead(value, 1).over(w), F.lag(value, 1).over(w)
    return F.coalesce((after - ahead) / 2, after - value, value - ahead)


def gradient(
    samples: DataFrame,
    value: str = "raw",
    keys: Sequence[str] = TRACE_KEYS,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add ``grad``: one exchange on (trace, chunk), then lead and lag."""
    w = chunk_window(keys)
    return (
        with_halo(samples, 1, chunk_bits)
        .withColumn("grad", gradient_of(value, w))
        .filter("is_home")
        .select(*samples.columns, "grad")
    )


def trend_of(value: str, w: WindowSpec, period: int) -> Column:
    """Centred moving average over one period; an even period halves its two end taps."""
    half = period // 2
    x = F.col(value)
    first, last = F.lag(x, half).over(w), F.lead(x, half).over(w)
    if period % 2:
        total = F.sum(x).over(w.rowsBetween(-half, half))
    else:
        total = F.sum(x).over(w.rowsBetween(1 - half, half - 1)) + (first + last) * 0.5
    return F.when(first.isNotNull() & last.isNotNull(), total / period)


def trend_gradient_of(value: str, w: WindowSpec, period: int) -> Column:
    """Gradient of the trend, from the few samples that enter and leave the average."""
    half = period // 2
    x = F.col(value)

    def step(k: int) -> Column:
        return F.lead(x, k).over(w) - F.lag(x, k).over(w)

    if period % 2:
        return (step(half) + step(half + 1)) / (2 * period)
    return (step(half - 1) * 0.5 + step(half) + step(half + 1) * 0.5) / (2 * period)


def decompose(
    samples: DataFrame,
    value: str = "raw",
    period: int = SEASON_PERIOD,
    keys: Sequence[str] = TRACE_KEYS,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Additive decomposition: ``trend``, ``seasonal`` and ``residual``.

    The trend is undefined near both ends.  Phase means of the detrended series
    are centred on their own mean; a trace shorter than two periods gets none.
    """
    trended = _trended(samples, value, period, keys, chunk_bits)
    phase = ((F.col("frame") - 1) % period).alias("phase")
    by_phase = (
        trended.groupBy(*keys, phase)
        .agg(
            F.avg(F.col(value) - F.col("trend")).alias("phase_mean"),
            F.max("frame").alias("last"),
        )
        .groupBy(*keys)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("phase", "phase_mean"))).alias("phases"),
            F.avg("phase_mean").alias("centre"),
            F.max("last").alias("last"),
        )
    )
    # One row per (trace, chunk), so that a long trace joins in many tasks.
    per_chunk = by_phase.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunk_of("last", chunk_bits)))
    ).drop("last")
    seasonal = F.try_element_at("phases", (F.col("frame") - 1) % period) - F.col("centre")
    return (
        # The rows are still partitioned by (trace, chunk): no second exchange.
        attach_stats(trended, per_chunk, keys)
        .withColumn("seasonal", seasonal)
        .withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
        .select(*samples.columns, "trend", "seasonal", "residual")
    )


def trend(
    samples: DataFrame,
    value: str = "raw",
    period: int = SEASON_PERIOD,
    keys: Sequence[str] = TRACE_KEYS,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add ``trend``.  A trace of fewer than two periods has no trend at all."""
    return _trended(samples, value, period, keys, chunk_bits).select(*samples.columns, "trend")


def _trended(
    samples: DataFrame, value: str, period: int, keys: Sequence[str], chunk_bits: int
) -> DataFrame:
    """Samples with ``chunk`` and ``trend``."""
    w = chunk_window(keys)
    # A halo of two periods is enough to tell a trace shorter than that.
    spread = with_halo(samples, 2 * period, chunk_bits)
    reach = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    long_enough = F.count(value).over(reach) >= 2 * period
    return (
        spread.withColumn("trend", F.when(long_enough, trend_of(value, w, period)))
        .filter("is_home")
        .select(*samples.columns, "chunk", "trend")
    )


def trend_gradient(
    samples: DataFrame,
    value: str = "raw",
    period: int = SEASON_PERIOD,
    keys: Sequence[str] = TRACE_KEYS,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add ``trend_grad``, NULL where a neighbouring trend value is undefined."""
    w = chunk_window(keys)
    return (
        with_halo(samples, period // 2 + 1, chunk_bits)
        .withColumn("trend_grad", trend_gradient_of(value, w, period))
        .filter("is_home")
        .select(*samples.columns, "trend_grad")
    )


def running_sum(
    samples: DataFrame,
    value: str = "raw",
    name: str = "running",
    keys: Sequence[str] = TRACE_KEYS,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add the cumulative sum of ``value`` by frame: per-chunk sums plus chunk offsets."""
    chunked = with_chunk(samples, chunk_bits)
    earlier = (
        Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = chunked.groupBy(*keys, "chunk").agg(F.sum(value).alias("_sum"))
    offsets = sums.withColumn("_before", F.sum("_sum").over(earlier)).drop("_sum")
    w = chunk_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum(value).over(w)
    before = F.col("_before")
    return (
        attach_stats(chunked, offsets, keys)
        .withColumn(name, F.when(before.isNull(), inside).otherwise(inside + before))
        .select(*samples.columns, name)
    )


def frame_axis(traces: DataFrame, keys: Sequence[str] = TRACE_KEYS) -> DataFrame:
    """Packed ``raw`` arrays to long samples with frames 1..n."""
    return traces.select(*keys, F.posexplode("raw").alias("pos", "raw")).select(
        *keys, (F.col("pos") + 1).alias("frame"), "raw"
    )


def pack(samples: DataFrame, keys: Sequence[str] = TRACE_KEYS) -> DataFrame:
    """Long samples to one ``raw`` array per trace, ordered by frame.

    Meant for export and plots of ordinary traces: an array holds a whole trace,
    so analysis stays on the long form.
    """
    cells = F.array_sort(F.collect_list(F.struct("frame", "raw")))
    return samples.groupBy(*keys).agg(cells.alias("cells")).select(
        *keys, F.col("cells.raw").alias("raw")
    )
