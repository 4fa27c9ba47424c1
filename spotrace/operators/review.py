"""Review pages and plot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotrace.model import PANEL_COLS, PANEL_ROWS, TRACE_KEYS
from spotrace.operators.ranking import bucketed_row_number

RANK_BLOCK = 4096

# Outline colours of boxes.
FUSED_COLOR = "cyan"
NOT_FUSED_COLOR = "yellow"
REJECTED_COLOR = "red"


def panel_columns(number: Column, rows: int = PANEL_ROWS, cols: int = PANEL_COLS) -> dict[str, Column]:
    """Zero-based page, row and column of the trace with this 1-based number."""
    place = number - 1
    per_page = rows * cols
    return {
        "panel": F.floor(place / per_page).cast("int"),
        "row": F.floor((place % per_page) / cols).cast("int"),
        "col": (place % cols).cast("int"),
    }


def panel_of(traces: DataFrame, rows: int = PANEL_ROWS, cols: int = PANEL_COLS) -> DataFrame:
    """Add ``panel``, ``row`` and ``col`` by trace number."""
    return traces.withColumns(panel_columns(F.col("trace_num"), rows, cols))


def rearrange(traces: DataFrame, rows: int, cols: int) -> DataFrame:
    """Lay the existing traces out again, closing gaps in the numbering."""
    return _numbered(traces).withColumns(panel_columns(F.col("place"), rows, cols)).drop("place")


def panel_count(traces: DataFrame, rows: int = PANEL_ROWS, cols: int = PANEL_COLS) -> DataFrame:
    """Pages per recording; an evenly filled last page is followed by an empty one."""
    return traces.groupBy("datum").agg(
        (F.floor(F.count(F.lit(1)) / (rows * cols)) + 1).cast("int").alias("n_panels")
    )


def page_slice(
    traces: DataFrame, panel: int, rows: int = PANEL_ROWS, cols: int = PANEL_COLS
) -> DataFrame:
    """The traces on one page."""
    return panel_of(traces, rows, cols).filter(F.col("panel") == panel)


def on_page(number: Column, panel: Column | int, rows: int = PANEL_ROWS, cols: int = PANEL_COLS) -> Column:
    """Whether a typed trace number belongs to the page."""
    panel = F.lit(panel) if isinstance(panel, int) else panel
    first = panel * rows * cols
    return (number > first) & (number <= first + rows * cols)


def _numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    block = F.floor(F.col("trace_num") / RANK_BLOCK)
    return bucketed_row_number(rows, ["datum"], block, ["trace_num"], name)


def resume_panel(
    status: DataFrame, rows: int = PANEL_ROWS, cols: int = PANEL_COLS, traces: DataFrame | None = None
) -> DataFrame:
    """Page of the first unreviewed trace in saved order, -1 when all are reviewed.

    With ``traces``, a trace without labels is unreviewed.
    """
    if traces is not None:
        labels = status.select(*TRACE_KEYS, "is_reviewed")
        status = traces.select(*TRACE_KEYS).distinct().join(labels, list(TRACE_KEYS), "left").fillna(False, ["is_reviewed"])
    first_open = F.min(F.when(~F.col("is_reviewed"), F.col("place")))
    return _numbered(status.select(*TRACE_KEYS, "is_reviewed")).groupBy("datum").agg(
        first_open.alias("first_open")
    ).select(
        "datum",
        F.coalesce(panel_columns(F.col("first_open"), rows, cols)["panel"], F.lit(-1)).alias("panel"),
    )


def event_color(boxes: DataFrame, status: DataFrame) -> DataFrame:
    """Outline colour of every box: fused, not fused, rejected or none."""
    labels = status.select(*TRACE_KEYS, "is_fusion")
    color = (
        F.when(~F.col("is_kept"), REJECTED_COLOR)
        .when(F.col("is_fusion"), FUSED_COLOR)
        .when(~F.col("is_fusion"), NOT_FUSED_COLOR)
    )
    return boxes.join(labels, list(TRACE_KEYS), "left").withColumn("color", color).select(
        *boxes.columns, "color"
    )


def annotations(
    status: DataFrame,
    changepoints: DataFrame,
    manifest: DataFrame,
    rows: int = PANEL_ROWS,
    cols: int = PANEL_COLS,
) -> DataFrame:
    """Vertical lines of the trace plots: one row per (trace, kind, frame)."""
    from spotrace.operators.changepoints import attach_start

    labelled = attach_start(status, manifest)
    fused, binding_kind = F.col("is_fusion"), F.col("start_frame") == 0

    def line(kind: str, shown: Column, frame: Column) -> Column:
        return F.when(
            shown, F.struct(F.lit(kind).alias("kind"), frame.cast("double").alias("frame"))
        )

    lines = F.array(
        line("start", ~binding_kind, F.col("start_frame")),
        line("binding", fused & binding_kind, F.col("binding")),
        line("fusion_start", fused, F.col("fusion_start")),
        line("fusion_mid", fused, (F.col("fusion_start") + F.col("fusion_end")) / 2),
        line("fusion_end", fused, F.col("fusion_end")),
    )
    drawn = labelled.select(*TRACE_KEYS, F.explode(F.array_compact(lines)).alias("l")).select(
        *TRACE_KEYS, "l.kind", "l.frame"
    )
    jumps = changepoints.select(
        *TRACE_KEYS, F.lit("changepoint").alias("kind"), F.col("frame").cast("double").alias("frame")
    )
    panel = panel_columns(F.col("trace_num"), rows, cols)["panel"]
    return drawn.unionByName(jumps).withColumn("panel", panel)
