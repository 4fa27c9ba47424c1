"""Text files of traces, labels, changepoints and dwell times.

Each family has a parser (lines to table), a formatter (table to lines), and a
reader and writer built from them.  Files of one recording live in a folder
``label=<label>``; the label comes back as a partition column.  Writers keep a
record in one file but spread the records of a recording over as many files as
there are tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotrace.functions.chunks import chunk_of
from spotrace.model import STATUS_HEADER_BINDING, STATUS_HEADER_FLOW, TRACE_KEYS
from spotrace.operators.labels import match_labels
from spotrace.session import broadcast_if_small

# Values per text line of a trace record.  Readers split on commas only, so a
# long record may continue on the next line.
LINE_BITS = 13


def _label_of_file() -> Column:
    """Label of a row's file: its folder ``label=...``, or the stem without tag and ``_IntensityTraces``."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"label=([^/]+)/[^/]*$", 1)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_IntensityTraces)?_[^_]*$", 1)
    return F.when(folder != "", folder).otherwise(stem)


def _or_error(known: Column, kind: str, message: Column) -> Column:
    return F.coalesce(known, F.raise_error(message).cast(kind))


def _read_rows(
    spark: SparkSession, path: str, manifest: DataFrame, match: str, unmatched: str, separator: str | None = None
) -> DataFrame:
    """(datum, label, start_frame, value) of all records under ``path``.

    ``match`` is ``exact`` (folder or file stem) or ``contains`` (a label anywhere in the file name).  A file
    of no recording is an error, or left out with ``unmatched="drop"``.
    """
    if match not in ("exact", "contains") or unmatched not in ("error", "drop"):
        raise ValueError("match is 'exact' or 'contains', unmatched is 'error' or 'drop'")
    name = F.col("_metadata.file_name").alias("filename")
    text = spark.read.text(path, lineSep=separator).select(_label_of_file().alias("label"), name, "value")
    columns = ["datum", "label"] + (["start_frame"] if "start_frame" in manifest.columns else [])
    if match == "contains":
        hits = match_labels(text.select("filename").distinct(), manifest, "contains").select("filename", "label")
        text = text.drop("label").join(broadcast_if_small(hits), "filename", "left")
    rows = text.join(broadcast_if_small(manifest.select(*columns)), "label", "left" if unmatched == "error" else "inner")
    message = F.concat(F.lit("no recording for file "), "filename")
    datum = _or_error(F.col("datum"), rows.schema["datum"].dataType.simpleString(), message).alias("datum")
    return rows.select(datum, *columns[1:], "value")


def _with_label(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the label; a row of a recording that the manifest lacks is an error."""
    met = rows.join(broadcast_if_small(manifest.select("datum", "label")), "datum", "left")
    message = F.concat(F.lit("no label for recording "), F.col("datum").cast("string"))
    return met.withColumn("label", _or_error(F.col("label"), "string", message))


def _write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write (label, number, ..., value) ordered by record, each record within one file.

    Ranges of (label, number) become files, so a large recording is written by
    many tasks and its files, in name order, hold its records in order.
    """
    (
        lines.repartitionByRange("label", order[0])
        .sortWithinPartitions("label", *order)
        .select("label", "value")
        .write.mode("overwrite").partitionBy("label").text(path)
    )


# --- traces ---------------------------------------------------------------


def parse_traces(records: DataFrame) -> DataFrame:
    """``@``-separated records (column ``value``) to packed traces.

    The first line is the trace number, the rest comma-joined numbers; empty
    records and empty items do not count.
    """
    text = F.trim("value")
    head = F.trim(F.substring_index(text, "\n", 1))
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    items = F.filter(
        F.transform(F.split(body, ","), lambda t: F.regexp_replace(t, r"\s", "")), lambda t: t != ""
    )
    return records.filter(text != "").filter(F.regexp_replace("value", r"\s", "") != "").select(
        *[c for c in records.columns if c != "value"],
        head.cast("int").alias("trace_num"),
        F.transform(items, lambda t: t.cast("double")).alias("raw"),
    )


def read_traces(
    spark: SparkSession, path: str, manifest: DataFrame, match: str = "exact", unmatched: str = "error"
) -> DataFrame:
    """Long samples of all trace files under ``path``; files are matched as in :func:`_read_rows`."""
    packed = parse_traces(_read_rows(spark, path, manifest, match, unmatched, "@"))
    return packed.select(*TRACE_KEYS, F.posexplode("raw").alias("pos", "raw")).select(
        *TRACE_KEYS, (F.col("pos") + 1).alias("frame"), "raw"
    )


def format_traces(samples: DataFrame) -> DataFrame:
    """One text line per chunk of a trace, the first with the record mark before it."""
    chunk = chunk_of("frame", LINE_BITS)
    cells = F.array_sort(F.collect_list(F.struct("frame", "raw")))
    lines = samples.groupBy(*TRACE_KEYS, chunk.alias("chunk")).agg(cells.alias("cells"))
    body = F.concat_ws(",", F.transform("cells.raw", lambda v: v.cast("string")))
    mark = F.concat(F.lit("@"), F.col("trace_num").cast("string"), F.lit("\n"))
    return lines.select(
        *TRACE_KEYS, "chunk",
        F.when(F.col("chunk") == 0, F.concat(mark, body)).otherwise(F.concat(F.lit(","), body)).alias("value"),
    )


def write_traces(samples: DataFrame, path: str, manifest: DataFrame) -> None:
    """Write the text form; Parquet is the native sink."""
    _write_lines(_with_label(format_traces(samples), manifest), path, ["trace_num", "chunk"])


# --- labels ---------------------------------------------------------------


def parse_status(lines: DataFrame) -> DataFrame:
    """Label lines (``datum, start_frame, value``) to status rows, after the load rule.

    Rows have 7 fields when the recording starts at frame 0 and 6 otherwise; an
    excluded row loses its fusion.  Header lines do not count.
    """
    fields = F.transform(F.split("value", ","), lambda t: F.trim(t).try_cast("int"))
    rows = lines.select("datum", "start_frame", fields.alias("f")).filter(F.get("f", F.lit(0)).isNotNull())
    binding_kind = F.col("start_frame") == 0
    shift = F.when(binding_kind, 1).otherwise(0)

    def item(place: int, shifted: bool = True) -> Column:
        return F.get("f", F.lit(place) + (shift if shifted else 0))

    excluded = item(5) != 0
    keep = (item(2, False) != 0) & ~excluded
    return rows.select(
        "datum",
        item(0, False).alias("trace_num"),
        (item(1, False) != 0).alias("is_reviewed"),
        keep.alias("is_fusion"),
        F.when(keep & binding_kind, item(3, False)).otherwise(0).alias("binding"),
        F.when(keep, item(3)).otherwise(0).alias("fusion_start"),
        F.when(keep, item(4)).otherwise(0).alias("fusion_end"),
        excluded.alias("is_excluded"),
    )


def read_status(
    spark: SparkSession, path: str, manifest: DataFrame, match: str = "exact", unmatched: str = "error"
) -> DataFrame:
    """Labels of all recordings under ``path``; a header-only file gives no rows."""
    return parse_status(_read_rows(spark, path, manifest, match, unmatched))


def format_status(status: DataFrame, manifest: DataFrame) -> DataFrame:
    """Label lines with 0/1 flags; empty page slots (number 0) are not written."""
    kinds = broadcast_if_small(manifest.select("datum", "start_frame"))
    rows = _with_label(status.filter("trace_num <> 0").join(kinds, "datum", "left"), manifest)

    def text(*names: str) -> Column:
        return F.concat_ws(",", *[F.col(n).cast("int").cast("string") for n in names])

    head, tail = ("trace_num", "is_reviewed", "is_fusion"), ("fusion_start", "fusion_end", "is_excluded")
    line = F.when(F.col("start_frame") == 0, text(*head, "binding", *tail)).otherwise(text(*head, *tail))
    return rows.select("datum", "label", "start_frame", "trace_num", line.alias("value"))


def status_headers(manifest: DataFrame) -> DataFrame:
    """The header line of every recording's label file."""
    header = F.when(F.col("start_frame") == 0, STATUS_HEADER_BINDING).otherwise(STATUS_HEADER_FLOW)
    return manifest.select("datum", "label", "start_frame", F.lit(0).alias("trace_num"), header.alias("value"))


def write_status(status: DataFrame, path: str, manifest: DataFrame) -> None:
    """Write label files, with the header of the recording's variant before its first row."""
    lines = format_status(status, manifest).unionByName(status_headers(manifest))
    _write_lines(lines, path, ["trace_num"])


def init_status(path: str, manifest: DataFrame) -> None:
    """Create header-only label files unless the folder exists."""
    status_headers(manifest).select("label", "value").write.mode("ignore").partitionBy("label").text(path)


# --- changepoints ---------------------------------------------------------


def parse_changepoints(lines: DataFrame) -> DataFrame:
    """Ragged lines ``trace_num,frame,...`` to lists; lines with anything unreadable are skipped."""
    numbers = F.transform(F.split("value", ","), lambda t: F.trim(t).try_cast("int"))
    return (
        lines.withColumn("f", numbers).filter(F.forall("f", lambda v: v.isNotNull()))
        .select(
            *[c for c in lines.columns if c != "value"],
            F.get("f", F.lit(0)).alias("trace_num"),
            F.slice("f", F.lit(2), F.size("f") - 1).alias("changepoints"),
        )
    )


def read_changepoints(
    spark: SparkSession, path: str, manifest: DataFrame, match: str = "exact", unmatched: str = "error"
) -> DataFrame:
    return parse_changepoints(_read_rows(spark, path, manifest, match, unmatched)).select(*TRACE_KEYS, "changepoints")


def format_changepoints(lists: DataFrame) -> DataFrame:
    """One line per trace, also for traces without any changepoint."""
    numbers = F.transform(F.array_sort("changepoints"), lambda v: v.cast("string"))
    line = F.concat_ws(",", F.col("trace_num").cast("string"), numbers)
    return lists.select(*TRACE_KEYS, line.alias("value"))


def write_changepoints(lists: DataFrame, path: str, manifest: DataFrame) -> None:
    _write_lines(_with_label(format_changepoints(lists), manifest), path, ["trace_num"])


# --- dwell times ----------------------------------------------------------


def parse_dwell_times(lines: DataFrame) -> DataFrame:
    """Comma-joined seconds to rows; a line with anything unreadable is skipped whole."""
    numbers = F.transform(F.split("value", ","), lambda t: F.trim(t).try_cast("double"))
    return (
        lines.withColumn("t", numbers).filter(F.forall("t", lambda v: v.isNotNull()))
        .select(*[c for c in lines.columns if c != "value"], F.explode("t").alias("dwell_s"))
    )


def read_dwell_times(
    spark: SparkSession, path: str, manifest: DataFrame, match: str = "exact", unmatched: str = "error"
) -> DataFrame:
    return parse_dwell_times(_read_rows(spark, path, manifest, match, unmatched)).select("datum", "dwell_s")


def format_dwell_times(dwell: DataFrame, block: int = 65_536) -> DataFrame:
    """Sorted seconds as text lines, written in blocks of ranks."""
    from spotrace.operators.stats import ecdf

    ranked = ecdf(dwell.select("datum", "dwell_s"))
    part = F.floor((F.col("rank") - 1) / block)
    cells = F.array_sort(F.collect_list(F.struct("rank", "dwell_s")))
    return ranked.groupBy("datum", part.alias("part")).agg(cells.alias("cells")).select(
        "datum", "part",
        F.concat_ws(",", F.transform("cells.dwell_s", lambda v: v.cast("string"))).alias("value"),
    )


def write_dwell_times(dwell: DataFrame, path: str, manifest: DataFrame) -> None:
    """One sorted line per recording; very large recordings continue on further lines."""
    _write_lines(_with_label(format_dwell_times(dwell), manifest), path, ["part"])


# --- detections -----------------------------------------------------------


def write_detections(status: DataFrame, path: str) -> None:
    """Automatic labels as Parquet by recording; repeated runs replace, never append twice."""
    (
        status.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("datum").parquet(path)
    )


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def detection_lines(status: DataFrame, manifest: DataFrame) -> DataFrame:
    """Automatic labels in the label-file form."""
    return format_status(status, manifest)


def training_lines(samples: DataFrame, status: DataFrame) -> DataFrame:
    """``label:v1,v2,...`` lines of reviewed, not excluded traces (one line per trace by format)."""
    from spotrace.operators.events import training_set

    cells = F.array_sort(F.collect_list(F.struct("frame", "raw")))
    packed = training_set(samples, status).groupBy(*TRACE_KEYS, "label").agg(cells.alias("cells"))
    body = F.concat_ws(",", F.transform("cells.raw", lambda v: v.cast("string")))
    return packed.select(*TRACE_KEYS, F.concat_ws(":", F.col("label").cast("string"), body).alias("value"))
