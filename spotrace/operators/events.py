"""Event labels: automatic labels, folded review actions, dwell times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotrace.functions.chunks import chunk_of
from spotrace.model import PANEL_COLS, PANEL_ROWS, TRACE_KEYS
from spotrace.operators.changepoints import attach_start
from spotrace.operators.review import panel_columns

# How many changepoints an automatic label needs, for recordings
# with binding events (start frame 0) and with a flow start.
MORE_THAN_BINDING = 2
MORE_THAN_FLOW = 1

STATUS_COLUMNS = (
    *TRACE_KEYS, "is_reviewed", "is_fusion", "binding", "fusion_start", "fusion_end", "is_excluded"
)


def auto_status(
    changepoints: DataFrame,
    traces: DataFrame,
    manifest: DataFrame,
    more_than_binding: int = MORE_THAN_BINDING,
    more_than_flow: int = MORE_THAN_FLOW,
) -> DataFrame:
    """Label every trace from its changepoints.

    Start frame 0: binding and fusion are the first and second changepoint.
    Otherwise fusion is the first.  Only the count and the two earliest frames
    of a trace are needed, so chunks are reduced before a trace is.
    """
    per_chunk = changepoints.groupBy(*TRACE_KEYS, chunk_of("frame").alias("chunk")).agg(
        F.count(F.lit(1)).alias("found"),
        F.slice(F.array_sort(F.collect_list("frame")), 1, 2).alias("earliest"),
    )
    per_trace = per_chunk.groupBy(*TRACE_KEYS).agg(
        F.sum("found").alias("found"),
        F.slice(F.array_sort(F.flatten(F.collect_list("earliest"))), 1, 2).alias("earliest"),
    )
    labelled = attach_start(traces.select(*TRACE_KEYS), manifest).join(
        per_trace, list(TRACE_KEYS), "left"
    )
    binding_kind = F.col("start_frame") == 0
    needed = F.when(binding_kind, more_than_binding).otherwise(more_than_flow)
    fused = F.coalesce(F.col("found"), F.lit(0)) > needed
    first, second = F.try_element_at("earliest", F.lit(1)), F.try_element_at("earliest", F.lit(2))
    fusion = F.when(fused, F.when(binding_kind, second).otherwise(first)).otherwise(0)
    return labelled.select(
        *TRACE_KEYS,
        F.lit(True).alias("is_reviewed"),
        fused.alias("is_fusion"),
        F.when(fused & binding_kind, first).otherwise(0).alias("binding"),
        fusion.alias("fusion_start"),
        fusion.alias("fusion_end"),
        F.lit(False).alias("is_excluded"),
    )


def mark_reviewed(status: DataFrame) -> DataFrame:
    """Every automatically labelled trace counts as reviewed."""
    return status.withColumn("is_reviewed", F.lit(True))


def eligible_events(status: DataFrame) -> DataFrame:
    """Fused and not excluded."""
    return status.filter("is_fusion AND NOT is_excluded")


def dwell_times(status: DataFrame, manifest: DataFrame) -> DataFrame:
    """Seconds from binding (start frame 0) or from the flow start to fusion."""
    events = attach_start(eligible_events(status), manifest)
    origin = F.when(F.col("start_frame") == 0, F.col("binding")).otherwise(F.col("start_frame"))
    return events.select(
        *TRACE_KEYS,
        ((F.col("fusion_start") - origin) * F.col("time_interval_s")).alias("dwell_s"),
    )


def fold_actions(actions: DataFrame, manifest: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Final state of every trace after its review actions, by sequence.

    With ``traces`` every trace of the recordings has a row, untouched ones not reviewed and not fused, as label
    files list them; an action on a trace that does not exist is then an error.

    ``f`` fuses with the given times and leaves exclusion alone, ``x`` excludes,
    ``u`` undoes both, ``n`` marks reviewed and nothing unsets it.  All parts are
    ordered aggregates, so a busy trace is reduced before the shuffle.
    """
    action, seq = F.col("action"), F.col("seq")
    times = F.struct(*[F.round(t).cast("int").alias(t) for t in ("t1", "t2", "t3")])
    folded = actions.groupBy(*TRACE_KEYS).agg(
        F.max_by(F.when(action.isin("f", "x", "u"), action), F.when(action.isin("f", "x", "u"), seq)).alias("outcome"),
        F.max_by(F.when(action.isin("x", "u"), action), F.when(action.isin("x", "u"), seq)).alias("excluded_by"),
        F.max_by(F.when(action == "f", times), F.when(action == "f", seq)).alias("t"),
        F.max(action == "n").alias("is_reviewed"),
    )
    if traces is not None:
        folded = _of_all(traces, folded)
    fused = F.coalesce(F.col("outcome") == "f", F.lit(False))
    binding_kind = F.col("start_frame") == 0

    def when_fused(binding_value, flow_value):
        return F.when(fused, F.when(binding_kind, binding_value).otherwise(flow_value)).otherwise(0)

    return attach_start(folded, manifest).select(
        *TRACE_KEYS,
        F.coalesce("is_reviewed", F.lit(False)).alias("is_reviewed"),
        fused.alias("is_fusion"),
        when_fused(F.col("t.t1"), F.lit(0)).alias("binding"),
        when_fused(F.col("t.t2"), F.col("t.t1")).alias("fusion_start"),
        when_fused(F.col("t.t3"), F.col("t.t2")).alias("fusion_end"),
        F.coalesce(F.col("excluded_by") == "x", F.lit(False)).alias("is_excluded"),
    )


def _unknown_trace() -> Column:
    return F.raise_error(F.concat(
        F.lit("no trace "), F.col("trace_num").cast("string"), F.lit(" in recording "), F.col("datum").cast("string")))


def _of_all(traces: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by trace with those that only ``traces`` has; a row of a trace that it lacks is an error."""
    known = traces.select(*TRACE_KEYS).distinct().withColumn("_known", F.lit(True))
    met = rows.join(known, list(TRACE_KEYS), "full")
    number = F.when(F.col("_known"), F.col("trace_num")).otherwise(_unknown_trace().cast(rows.schema["trace_num"].dataType))
    return met.withColumn("trace_num", number).drop("_known")


def reload_status(status: DataFrame) -> DataFrame:
    """What is left of labels after saving and loading: excluded rows lose their fusion."""
    keep = F.col("is_fusion") & ~F.col("is_excluded")
    zero = {c: F.when(keep, F.col(c)).otherwise(0).alias(c) for c in ("binding", "fusion_start", "fusion_end")}
    return status.select(
        *TRACE_KEYS, "is_reviewed", keep.alias("is_fusion"),
        zero["binding"], zero["fusion_start"], zero["fusion_end"], "is_excluded",
    )


def expand_page_actions(
    page_actions: DataFrame, traces: DataFrame, rows: int = PANEL_ROWS, cols: int = PANEL_COLS
) -> DataFrame:
    """Turn (datum, panel, seq, action) into one action per trace on the page."""
    placed = traces.select(*TRACE_KEYS, panel_columns(F.col("trace_num"), rows, cols)["panel"].alias("panel"))
    none = F.lit(None).cast("double")
    return page_actions.join(placed, ["datum", "panel"]).select(
        *TRACE_KEYS, "seq", "action", none.alias("t1"), none.alias("t2"), none.alias("t3")
    )


def click_arity(actions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Flag fusion actions that lack a point: three are needed for start frame 0, else two."""
    joined = attach_start(actions, manifest)
    two = F.col("t1").isNotNull() & F.col("t2").isNotNull()
    enough = F.when(F.col("start_frame") == 0, two & F.col("t3").isNotNull()).otherwise(two)
    return joined.select(
        *TRACE_KEYS, "seq", "action",
        *[F.round(t).cast("int").alias(t) for t in ("t1", "t2", "t3")],
        ((F.col("action") != "f") | enough).alias("is_complete"),
    )


def attach_labels(traces: DataFrame, status: DataFrame) -> DataFrame:
    """Traces with their labels by number; a label of a number that the recording lacks is an error."""
    known = traces.withColumn("_known", F.lit(True))
    met = status.join(known, list(TRACE_KEYS), "left")
    number = F.when(F.col("_known"), F.col("trace_num")).otherwise(_unknown_trace().cast(status.schema["trace_num"].dataType))
    columns = [*traces.columns, *(c for c in status.columns if c not in TRACE_KEYS)]
    return met.withColumn("trace_num", number).select(*columns)


def unknown_labels(traces: DataFrame, status: DataFrame) -> DataFrame:
    """Labels whose trace number does not exist in the recording (an error for the caller)."""
    return status.join(traces.select(*TRACE_KEYS), list(TRACE_KEYS), "left_anti")


def fusion_mid(status: DataFrame) -> DataFrame:
    """Middle of the fusion interval."""
    return status.withColumn("fusion_mid", (F.col("fusion_start") + F.col("fusion_end")) / 2)


def training_set(samples: DataFrame, status: DataFrame) -> DataFrame:
    """Samples of reviewed, not excluded traces with the fusion flag as label."""
    wanted = status.filter("is_reviewed AND NOT is_excluded").select(
        *TRACE_KEYS, F.col("is_fusion").cast("int").alias("label")
    )
    return samples.join(wanted, list(TRACE_KEYS))


def review_progress(status: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Counts of reviewed, fused and excluded traces per recording; with ``traces``, untouched ones count too."""
    if traces is not None:
        flags = ("is_reviewed", "is_fusion", "is_excluded")
        status = _of_all(traces, status.select(*TRACE_KEYS, *flags)).fillna(False, list(flags))
    return status.groupBy("datum").agg(
        F.count(F.lit(1)).alias("n_traces"),
        F.count_if("is_reviewed").alias("n_reviewed"),
        F.count_if("is_fusion").alias("n_fused"),
        F.count_if("is_excluded").alias("n_excluded"),
    )
