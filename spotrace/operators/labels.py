"""Matching file names to recordings by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotrace.session import broadcast_if_small


def match_labels(files: DataFrame, manifest: DataFrame, match: str = "exact") -> DataFrame:
    """Add ``datum`` and ``label`` to rows with a ``filename``.

    ``exact`` takes the text before the first underscore-separated suffix as the
    label.  ``contains`` accepts a label anywhere in the name and prefers the
    first recording of the manifest; every substring of the name as long as some
    label is looked up in an equi-join, so no name meets all labels.
    """
    labels = broadcast_if_small(manifest.select("datum", "label"))
    if match == "exact":
        named = files.withColumn("label", F.regexp_extract("filename", r"^(.*)_[^_]*$", 1))
        return named.join(labels, "label").select(*files.columns, "datum", "label")
    if match != "contains":
        raise ValueError("match is 'exact' or 'contains'")
    lengths = manifest.select(F.array_sort(F.collect_set(F.length("label"))).alias("lengths")).scalar()
    size = F.length("filename")
    parts = (
        files.select("filename").distinct().withColumn("size", F.explode(lengths))
        .filter(F.col("size").between(1, size))
        .withColumn("start", F.explode(F.sequence(F.lit(1), size - F.col("size") + 1)))
        .select("filename", F.substring("filename", F.col("start"), F.col("size")).alias("label"))
    )
    first = parts.join(labels, "label").groupBy("filename").agg(
        F.min(F.struct("datum", "label")).alias("hit")
    )
    return files.join(first, "filename").select(*files.columns, "hit.datum", "hit.label")


def unmatched_files(files: DataFrame, matched: DataFrame) -> DataFrame:
    """Files that belong to no recording (an error for the caller)."""
    return files.join(matched.select("filename"), "filename", "left_anti")


def with_recording(df: DataFrame, manifest: DataFrame, *columns: str) -> DataFrame:
    """Add columns of the manifest to rows with a ``datum``; a recording that the manifest lacks is an error."""
    known = manifest.select(F.col("datum").alias("_datum"), *columns, F.lit(True).alias("_known"))
    met = df.join(broadcast_if_small(known), F.col("datum") == F.col("_datum"), "left")
    missing = F.raise_error(F.concat(F.lit("no recording "), F.coalesce(F.col("datum").cast("string"), F.lit("NULL"))))
    return met.select(*df.columns, *[
        F.when(F.col("_known"), F.col(c)).otherwise(missing.cast(manifest.schema[c].dataType)).alias(c) for c in columns
    ])
