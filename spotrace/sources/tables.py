"""Native Parquet tables: frames, samples, boxes, measurements, and where they live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotrace.model import FRAMES, OUTPUT_KINDS, PIXELS


def output_path(root: str, kind: str, source_file: str | None = None) -> str:
    """Folder of an output kind, or the file derived from a source file's stem."""
    folder, tag = OUTPUT_KINDS[kind]
    base = f"{root.rstrip('/')}/{folder}"
    if source_file is None:
        return base
    stem = source_file.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    extension = ".tif" if kind == "drawings" else ".txt"
    return f"{base}/{stem}{tag}{extension}"


def output_names(files: DataFrame, kind: str) -> DataFrame:
    """The same naming rule for a table with a ``filename`` column."""
    folder, tag = OUTPUT_KINDS[kind]
    extension = ".tif" if kind == "drawings" else ".txt"
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return files.withColumn("output", F.concat(F.lit(f"{folder}/"), stem, F.lit(f"{tag}{extension}")))


def init_table(spark: SparkSession, path: str, schema) -> None:
    """Create an empty typed table unless the path exists."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def pending_datums(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Recordings without results yet."""
    return manifest.join(done.select("datum").distinct(), "datum", "left_anti")


def read_frames(spark: SparkSession, path: str, packed: bool = True) -> DataFrame:
    """A video table, packed or one row per pixel."""
    return spark.read.schema(FRAMES if packed else PIXELS).parquet(path)


def read_video_files(spark: SparkSession, path: str, decode, manifest: DataFrame) -> DataFrame:
    """Video files through a caller's decoder.

    ``decode(bytes)`` yields (height, width, flat values) per frame; files are
    decoded where they are read, frame by frame.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content"
    )
    named = manifest.select("datum", F.regexp_extract("filepath", r"([^/]+)$", 1).alias("name"))

    def frames(batches):
        for pdf in batches:
            for datum, content in zip(pdf["datum"], pdf["content"]):
                for number, (height, width, values) in enumerate(decode(content), start=1):
                    yield pd.DataFrame(
                        {"datum": [datum], "frame": [number], "height": [height],
                         "width": [width], "pixels": [values]}
                    )

    return files.join(named, "name").select("datum", "content").mapInPandas(frames, FRAMES)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by recording; recordings present in ``df`` are replaced, others stay."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("datum").parquet(path)
    )


def read_boxes(spark: SparkSession, path: str, kept_only: bool = False) -> DataFrame:
    boxes = spark.read.parquet(path)
    return boxes.filter("is_kept") if kept_only else boxes


def write_measurements(df: DataFrame, path: str) -> None:
    """Measurement table (peaks or particles) as CSV by recording."""
    df.write.mode("overwrite").partitionBy("datum").option("header", True).csv(path)
