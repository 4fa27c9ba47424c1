"""Splitting long series into bounded blocks of frames.

One trace may hold a large share of all samples, so no operator lets a whole
trace meet in one task.  Series are cut into chunks of ``2 ** chunk_bits``
frames; a sample close to a border is also sent to the neighbouring chunk (its
halo), so that windows over (trace, chunk) see every neighbour they need.  For
the usual trace of a few hundred frames everything is chunk 0 and the split is
free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_BITS = 13


def chunk_of(frame: Column | str, bits: int = CHUNK_BITS) -> Column:
    frame = F.col(frame) if isinstance(frame, str) else frame
    return F.shiftright((frame - 1).cast("int"), bits)


def with_chunk(df: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    return df.withColumn("chunk", chunk_of("frame", bits))


def with_halo(df: DataFrame, halo: int, bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``chunk`` and ``is_home``; border samples appear once per chunk that needs them."""
    first = F.greatest(chunk_of(F.col("frame") - halo, bits), F.lit(0))
    last = chunk_of(F.col("frame") + halo, bits)
    spread = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return spread.withColumn("is_home", F.col("chunk") == chunk_of("frame", bits))


def chunk_window(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy("frame")


def series_stats(
    samples: DataFrame, keys: Sequence[str], value: str = "raw", bits: int = CHUNK_BITS
) -> DataFrame:
    """One row per (trace, chunk) with the statistics of the whole trace.

    Columns: ``n, mean, var_samp, std_pop, lo, hi`` of the trace and
    ``before``, the sum of (value - mean) over all earlier chunks.  The raw
    samples are reduced map-side per chunk; only chunk rows meet per trace.
    """
    per_chunk = samples.groupBy(*keys, chunk_of("frame", bits).alias("chunk")).agg(
        F.count(value).alias("c_n"),
        F.sum(value).alias("c_sum"),
        F.var_pop(value).alias("c_var"),
        F.min(value).alias("c_lo"),
        F.max(value).alias("c_hi"),
    )
    whole = whole_trace(keys)
    return trace_totals(
        per_chunk, keys, F.min("c_lo").over(whole).alias("lo"), F.max("c_hi").over(whole).alias("hi")
    )


def whole_trace(keys: Sequence[str]) -> WindowSpec:
    """All chunk rows of a trace, in order."""
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )


def trace_totals(per_chunk: DataFrame, keys: Sequence[str], *carried: Column | str) -> DataFrame:
    """Trace statistics from chunk rows with ``c_n, c_sum, c_var``, keeping ``carried`` columns."""
    whole = whole_trace(keys)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    totals = per_chunk.select(
        *keys, "chunk", "c_n", "c_sum", "c_var", *carried,
        F.sum("c_n").over(whole).alias("n"),
        F.sum("c_sum").over(whole).alias("total"),
        F.coalesce(F.sum("c_n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("c_sum").over(earlier), F.lit(0.0)).alias("sum_before"),
    ).withColumn("mean", F.col("total") / F.col("n"))
    off = F.col("c_sum") / F.col("c_n") - F.col("mean")
    spread = F.sum(F.col("c_n") * (F.col("c_var") + off * off)).over(whole)
    fixed = {*keys, "chunk", "c_n", "c_sum", "c_var", "n", "total", "n_before", "sum_before", "mean"}
    kept = [c for c in totals.columns if c not in fixed]
    return totals.withColumn("m2", spread).select(
        *keys, "chunk", *kept,
        F.col("n").cast("int").alias("n"), "mean",
        F.expr("try_divide(m2, n - 1)").alias("var_samp"),
        F.sqrt(F.col("m2") / F.col("n")).alias("std_pop"),
        (F.col("sum_before") - F.col("mean") * F.col("n_before")).alias("before"),
    )


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join chunked samples with rows per (trace, chunk).

    The chunk in the key spreads a hot trace over many tasks.  The hint keeps
    the small side as the hash table of each partition: samples are shuffled
    once, never broadcast or sorted for the join, and the windows that follow
    reuse the partitioning.
    """
    return df.join(stats.hint("shuffle_hash"), [*keys, "chunk"])
