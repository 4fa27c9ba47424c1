"""The recording manifest: one CSV row per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotrace.model import (
    DEFAULT_INTERVAL_S,
    DEFAULT_PEAK_PROMINENCE,
    DEFAULT_PROFILE_TOLERANCE,
    DEFAULT_ROLLING_RADIUS,
    DEFAULT_START_FRAME,
    MANIFEST_HEADER,
)

# Labels are promised to have this form.
LABEL_PATTERN = r"^[A-Za-z0-9-]+$"

_DEFAULTS = {
    "start_frame": ("int", DEFAULT_START_FRAME),
    "time_interval_s": ("double", DEFAULT_INTERVAL_S),
    "rolling_radius": ("int", DEFAULT_ROLLING_RADIUS),
    "peak_prominence": ("double", DEFAULT_PEAK_PROMINENCE),
    "profile_tolerance": ("double", DEFAULT_PROFILE_TOLERANCE),
}
_COLUMN_OF = dict(
    zip(
        MANIFEST_HEADER,
        ("label", "start_frame", "time_interval_s", "rolling_radius", "peak_prominence",
         "profile_tolerance", "filepath"),
    )
)


def parse_manifest(files: DataFrame) -> DataFrame:
    """Rows of whole manifest texts (column ``value``), numbered 1..N in file order.

    Columns are taken by header name, so the 2-, 4- and 7-column forms all read;
    fields a form lacks are NULL.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda t: F.trim(t) != "")
    rows = files.select(lines.alias("lines")).select(
        F.transform(F.split(F.element_at("lines", 1), ","), lambda t: F.trim(t)).alias("header"),
        F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line"),
    )
    cells = rows.withColumn("values", F.transform(F.split("line", ","), lambda t: F.trim(t)))

    def field(name: str) -> Column:
        place = F.array_position("header", F.lit(name)).cast("int")
        return F.when(place > 0, F.get("values", place - 1))

    def number(text: Column, kind: str) -> Column:
        """An empty field is missing, an unreadable one an error."""
        wrong = F.raise_error(F.concat(F.lit("unreadable number in the manifest: "), text)).cast(kind)
        return F.when(text != "", F.coalesce(text.try_cast(kind), wrong))

    typed = {
        column: field(header) if column in ("label", "filepath") else number(field(header), _DEFAULTS[column][0])
        for header, column in _COLUMN_OF.items()
    }
    return cells.select((F.col("pos") + 1).alias("datum"), *[c.alias(n) for n, c in typed.items()])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read a manifest file; a missing file is an error.

    The file is read whole, which keeps its row order without a sort; it holds
    one short line per video.
    """
    return parse_manifest(spark.read.text(path, wholetext=True))


def manifest_with_defaults(
    manifest: DataFrame, overrides: DataFrame | None = None, **defaults: float
) -> DataFrame:
    """Fill missing parameters and add ``is_label_valid``.

    ``overrides`` holds rows (label, any parameter columns) that win over the
    file; keyword arguments replace the built-in defaults.
    """
    unknown = set(defaults) - set(_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    given = manifest
    present = []
    if overrides is not None:
        present = [c for c in _DEFAULTS if c in overrides.columns]
        renamed = overrides.select("label", *[F.col(c).alias(f"new_{c}") for c in present])
        given = manifest.join(renamed, "label", "left")

    def value(name: str) -> Column:
        kind, fallback = _DEFAULTS[name]
        options = [F.col(f"new_{name}")] if name in present else []
        if name in manifest.columns:
            options.append(F.col(name))
        return F.coalesce(*options, F.lit(defaults.get(name, fallback))).cast(kind).alias(name)

    return given.select(
        "datum", "label", *[value(name) for name in _DEFAULTS],
        *(["filepath"] if "filepath" in manifest.columns else []),
        F.col("label").rlike(LABEL_PATTERN).alias("is_label_valid"),
    )


def format_manifest(manifest: DataFrame) -> DataFrame:
    """Seven-column CSV lines, header first, as one text per manifest (column ``value``)."""
    fields = ["label", "start_frame", "time_interval_s", "rolling_radius", "peak_prominence",
              "profile_tolerance", "filepath"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in fields])
    ordered = F.array_sort(F.collect_list(F.struct(F.col("datum"), line.alias("line"))))
    return manifest.agg(ordered.alias("rows")).select(
        F.concat_ws("\n", F.lit(",".join(MANIFEST_HEADER)), F.col("rows.line")).alias("value")
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Write the manifest as one text file in a folder (one short line per video)."""
    format_manifest(manifest).coalesce(1).write.mode("overwrite").text(path)
