"""Dwell-time statistics: empirical curve, moments, gamma fit and its quality.

Everything after ``dwell_counts`` works on (recording, distinct dwell time,
count).  Dwell times are frame counts times an interval, so that table has at
most one row per frame of a recording, however many events there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotrace.functions.gamma import digamma_sql, gamma_cdf, lgamma_sql, trigamma_sql
from spotrace.session import materialize

TIE_BLOCK = 65_536

# Fixed values of the fit: the location lies below the smallest dwell time by
# 10 ** e times the range, e between these exponents; each round narrows e.
LOC_LOW = -3.0
LOC_HIGH = 1.0
LOC_POINTS = 17
LOC_ROUNDS = 3
NEWTON_STEPS = 4


def dwell_counts(dwell: DataFrame) -> DataFrame:
    """Distinct dwell times with count ``c``, earlier count ``before`` and total ``n``."""
    counts = dwell.groupBy("datum", "dwell_s").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("datum").orderBy("dwell_s")
    return counts.select(
        "datum", "dwell_s", "c",
        F.coalesce(
            F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        F.sum("c").over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("n"),
    )


def ecdf(dwell: DataFrame) -> DataFrame:
    """Empirical curve of each recording."""
    return ranks(dwell_counts(dwell))


def ranks(counts: DataFrame) -> DataFrame:
    """Sorted dwell times with ``p = rank / n``; ties get different ranks.

    Ranks are generated from the counts in blocks, so one very common dwell time
    does not become one very large row.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / TIE_BLOCK))
    first = F.col("block") * TIE_BLOCK + 1
    last = F.least(F.col("c"), first + (TIE_BLOCK - 1))
    return (
        counts
        .withColumn("block", F.explode(blocks))
        .withColumn("turn", F.explode(F.sequence(first, last)))
        .select(
            "datum", (F.col("before") + F.col("turn")).alias("rank"), "dwell_s",
            ((F.col("before") + F.col("turn")) / F.col("n")).alias("p"),
        )
    )


def dwell_moments(counts: DataFrame) -> DataFrame:
    """``n_min``: squared mean over variance, the reciprocal of the randomness."""
    whole = Window.partitionBy("datum")
    c, t = F.col("c"), F.col("dwell_s")
    centred = counts.withColumn("mean", F.sum(c * t).over(whole) / F.col("n"))
    return centred.groupBy("datum").agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        (F.sum(c * (t - F.col("mean")) * (t - F.col("mean"))) / F.max("n")).alias("variance"),
    ).withColumn("n_min", F.expr("try_divide(mean * mean, variance)"))


def _shape_and_likelihood(sums: DataFrame) -> DataFrame:
    """Maximum-likelihood shape for each trial location, then its log-likelihood.

    Starts from the closed form and takes a fixed number of generalised Newton
    steps; only n, the mean and the mean logarithm of the excess are needed.
    """
    newton = (
        f"1 / (1 / a + (ln(a) - {digamma_sql('a')} - s) / (a * a * (1 / a - {trigamma_sql('a')})))"
    )
    start = "(3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)"
    return (
        sums.withColumn("s", F.log("mean") - F.col("mean_log"))
        .filter("s > 0")
        .withColumn("shape", F.expr(f"aggregate(sequence(1, {NEWTON_STEPS}), {start}, (a, step) -> {newton})"))
        .withColumn("scale", F.col("mean") / F.col("shape"))
        .withColumn(
            "log_lik",
            F.expr(f"n * ((shape - 1) * mean_log - shape - shape * ln(scale) - {lgamma_sql('shape')})"),
        )
    )


def gamma_fit(counts: DataFrame) -> DataFrame:
    """Three-parameter gamma fit per recording: ``n, shape, loc, scale, log_lik, at_bound, gradient``.

    The likelihood is profiled over the location.  The likelihood of a gamma
    distribution grows without bound as the location meets the smallest
    observation, so trial locations stay a fixed fraction of the range away.
    Recordings whose dwell times are all equal have no fit.  ``at_bound`` tells that the best location lies at an end of
    those tried; ``gradient`` is the slope of the profile there, in log-likelihood per observation and range: near
    zero inside, and what the bound holds back at an end.
    """
    spans = counts.groupBy("datum").agg(
        F.min("dwell_s").alias("lo"), F.max("dwell_s").alias("hi"), F.sum("c").alias("n")
    ).filter("hi > lo")
    best = spans.withColumn("centre", F.lit((LOC_LOW + LOC_HIGH) / 2))
    reach = (LOC_HIGH - LOC_LOW) / 2

    def in_range(t):
        return F.greatest(F.least(F.col("centre") + t, F.lit(LOC_HIGH)), F.lit(LOC_LOW))

    for _ in range(LOC_ROUNDS):
        step = 2 * reach / (LOC_POINTS - 1)
        trials = F.array(*[F.lit(round(-reach + k * step, 12)) for k in range(LOC_POINTS)])
        tried = (
            counts.select("datum", "dwell_s", "c")
            .join(best.select("datum", "lo", "hi", "n", "centre"), "datum")
            .withColumn("e", F.explode(F.array_distinct(F.transform(trials, in_range))))
            .withColumn("loc", F.col("lo") - F.pow(F.lit(10.0), "e") * (F.col("hi") - F.col("lo")))
        )
        excess = F.col("dwell_s") - F.col("loc")
        sums = tried.groupBy("datum", "lo", "hi", "n", "e", "loc").agg(
            (F.sum(excess * F.col("c")) / F.col("n")).alias("mean"),
            (F.sum(F.log(excess) * F.col("c")) / F.col("n")).alias("mean_log"),
        )
        best = (
            _shape_and_likelihood(sums)
            .groupBy("datum")
            .agg(F.max_by(F.struct("lo", "hi", "n", "e", "loc", "shape", "scale", "log_lik"), "log_lik").alias("b"))
            .select("datum", "b.*")
            .withColumnRenamed("e", "centre")
        )
        reach = step
    e, span = F.col("centre"), F.col("hi") - F.col("lo")
    met = counts.select("datum", "dwell_s", "c").join(best, "datum")
    inverse = met.groupBy("datum").agg((F.sum(F.col("c") / (F.col("dwell_s") - F.col("loc"))) / F.max("n")).alias("inverse"))
    return best.join(inverse, "datum").select(
        "datum", "n", "shape", "loc", "scale", "log_lik",
        ((e <= LOC_LOW + reach / 2) | (e >= LOC_HIGH - reach / 2)).alias("at_bound"),
        ((1 / F.col("scale") - (F.col("shape") - 1) * F.col("inverse")) * span).alias("gradient"),
    )


def fitted_curve(counts: DataFrame, fit: DataFrame) -> DataFrame:
    """The fitted distribution function at each distinct dwell time."""
    return counts.join(fit.select("datum", "shape", "loc", "scale"), "datum", "left").select(
        "datum", "dwell_s", "c", "before", "n",
        gamma_cdf(F.col("dwell_s"), F.col("shape"), F.col("loc"), F.col("scale")).alias("fit"),
    )


def r_squared(curve: DataFrame) -> DataFrame:
    """1 - residual / total sum of squares of the ranks against the fitted curve.

    Ties are summed in closed form instead of row by row.
    """
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    gap = F.col("before") / n - F.col("fit")
    residual = (
        c * gap * gap + gap * c * (c + 1) / n + c * (c + 1) * (2 * c + 1) / (6 * n * n)
    )
    return curve.groupBy("datum").agg(
        F.sum(residual).alias("residual"), F.max(n).alias("size")
    ).select("datum", F.expr("1 - try_divide(residual, (size * size - 1) / (12 * size))").alias("r2"))


def fit_summary(dwell: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Label, n, shape, scale, location, n_min and R2 of every recording with dwell times."""
    counts = materialize(dwell_counts(dwell), "dwell")
    fit = materialize(gamma_fit(counts), "fit")
    moments = dwell_moments(counts)
    quality = r_squared(fitted_curve(counts, fit))
    joined = moments.join(fit.drop("n", "at_bound", "gradient"), "datum", "left").join(quality, "datum", "left")
    if manifest is not None:
        joined = joined.join(manifest.select("datum", "label"), "datum", "left")
    first = ["datum"] + (["label"] if manifest is not None else [])
    return joined.select(*first, "n", "shape", "loc", "scale", "n_min", "r2")


def curve_points(dwell: DataFrame, manifest: DataFrame) -> DataFrame:
    """Plot table: the empirical steps and the fitted curve of every recording."""
    counts = materialize(dwell_counts(dwell), "dwell")
    fitted = fitted_curve(counts, gamma_fit(counts)).select("datum", "dwell_s", "fit")
    return (
        ranks(counts)
        .join(fitted, ["datum", "dwell_s"])
        .join(manifest.select("datum", "label"), "datum")
        .select("datum", "label", "rank", "dwell_s", "p", "fit")
    )
