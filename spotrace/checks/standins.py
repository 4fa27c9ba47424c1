"""Stand-in recordings derived by Spark from the given tables.

Every function reads whole tables and scales with them; the matching SQL text
lives in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotrace.functions.chunks import attach_stats, chunk_of, with_chunk
from spotrace.operators.ranking import bucketed_row_number
from spotrace.operators.series import running_sum, trace_stats
from spotrace.session import broadcast_if_small, materialize

# Fixed values of the stand-in images: side length, quadrant split, and the
# centres and widths of the boxes.
SIDE = 16
SPLIT = 8
BOX_LIST = ((1, 4, 4, 3), (2, 10, 6, 5), (3, 8, 12, 3))  # (trace_num, cx, cy, width)
# Actions by event type.
ACTION_OF = {"purchase": "f", "error": "x", "signup": "u", "view": "n", "click": "n"}


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stand-in table written once per session, as a recording would be, then scanned."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialize(build(), name)
    return _stored[key]


def folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a stored stand-in lies, for reading it as a stream."""
    first = _stored[(spark.sparkContext.applicationId, sf_dir, name)].inputFiles()[0]
    return first.rsplit("/", 1)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_line_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as particles, their line items by ship date as frames."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("trace_num"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").alias("raw"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "raw"]
    numbered = bucketed_row_number(items, ["trace_num"], F.to_date("l_shipdate"), order, "frame")
    return numbered.select(
        (F.col("trace_num") % 4).alias("datum"), "trace_num", "frame", "raw"
    )


def line_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "line_traces", lambda: build_line_traces(spark, sf_dir))


def build_walk_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of (raw - trace mean): a drifting series with real level changes.

    Sums run in whole cents, so that the values do not depend on the order of
    additions.
    """
    cents = line_traces(spark, sf_dir).withColumn("raw", F.round(F.col("raw") * 100).cast("long"))
    totals = cents.groupBy("datum", "trace_num").agg(
        F.count("raw").alias("n"), F.sum("raw").alias("total"), F.max("frame").alias("last")
    )
    summed = running_sum(cents)
    per_chunk = totals.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_of("last"))))
    joined = attach_stats(with_chunk(summed), per_chunk, ["datum", "trace_num"])
    mean = F.col("total").cast("double") / 100.0 / F.col("n").cast("double")
    return joined.select(
        "datum", "trace_num", "frame",
        (F.col("running").cast("double") / 100.0 - F.col("frame").cast("double") * mean).alias("raw"),
    )


def walk_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "walk_traces", lambda: build_walk_traces(spark, sf_dir))


def walk_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "walk_regions", lambda: build_walk_regions(walk_traces(spark, sf_dir))
    )


def build_walk_regions(walk: DataFrame) -> DataFrame:
    """Four region series per recording: sums of its walk traces."""
    region = (F.floor(F.col("trace_num") / 4) % 4 + 1).cast("int").alias("region")
    return walk.groupBy("datum", region, "frame").agg(F.sum("raw").alias("raw"))


def line_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "line_manifest", lambda: build_line_manifest(spark, sf_dir))


def build_line_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording found in the line items; odd recordings start at frame 100."""
    suppliers = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("datum")
    )
    return suppliers.distinct().select(
        "datum",
        F.concat(F.lit("Datum-"), F.col("datum").cast("string")).alias("label"),
        F.when(F.col("datum") % 2 == 0, 0).otherwise(100).alias("start_frame"),
        F.lit(0.5).alias("time_interval_s"),
    )


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "event_types", lambda: build_event_types(spark, sf_dir))


def build_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each event type in alphabetical order (a handful of rows)."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select(
        "event_type",
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_type")) - 1).alias("datum"),
    )


def build_event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as photons: type = recording, day = frame, user and hour = position."""
    kinds = event_types(spark, sf_dir)
    sums = (
        table(spark, sf_dir, "events")
        .groupBy(
            "event_type",
            F.dayofmonth("ts").alias("frame"),
            (F.col("user_id") % SIDE).cast("int").alias("y"),
            (F.hour("ts") % SIDE).alias("x"),
        )
        .agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        .join(kinds, "event_type")
    )
    days = sums.groupBy("datum").agg(F.max("frame").alias("last"))
    cells = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = (
        days.select("datum", F.explode(F.sequence(F.lit(1), "last")).alias("frame"))
        .withColumn("y", F.explode(cells))
        .withColumn("x", F.explode(cells))
    )
    return grid.join(sums, ["datum", "frame", "y", "x"], "left").select(
        "datum", "frame", "y", "x",
        (F.coalesce("cents", F.lit(0)).cast("double") / 100.0).alias("v"),
    )


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "event_pixels", lambda: build_event_pixels(spark, sf_dir))


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed box list on every event recording."""
    boxes = F.array(
        *[
            F.struct(
                F.lit(num).alias("trace_num"),
                F.lit(cx - (w - 1) // 2).alias("x0"),
                F.lit(cy - (w - 1) // 2).alias("y0"),
                F.lit(w).alias("width"),
            )
            for num, cx, cy, w in BOX_LIST
        ]
    )
    return event_types(spark, sf_dir).select("datum", F.explode(boxes).alias("b")).select(
        "datum", F.col("b.trace_num").alias("box_num"), "b.*"
    )


def event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_of(table(spark, sf_dir, "events"))


def actions_of(events: DataFrame) -> DataFrame:
    """Events as review actions; ``event_id`` rises with time and serves as sequence."""
    action = F.lit(None).cast("string")
    for kind, key in ACTION_OF.items():
        action = F.when(F.col("event_type") == kind, key).otherwise(action)
    t1 = F.round(F.col("value"))
    return (
        events.select(
            (F.col("user_id") % 2).cast("int").alias("datum"),
            F.col("user_id").cast("int").alias("trace_num"),
            F.col("event_id").alias("seq"),
            action.alias("action"),
            t1.alias("t1"), (t1 + 10).alias("t2"), (t1 + 20).alias("t3"),
        )
        .filter(F.col("action").isNotNull())
    )


def event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "event_manifest", lambda: build_event_manifest(spark, sf_dir))


def build_event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 2).cast("int").alias("datum"))
    return users.distinct().select(
        "datum",
        F.concat(F.lit("Datum-"), F.col("datum").cast("string")).alias("label"),
        F.when(F.col("datum") == 0, 0).otherwise(100).alias("start_frame"),
        F.lit(0.5).alias("time_interval_s"),
    )


def order_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "order_manifest", lambda: build_order_manifest(spark, sf_dir))


def build_order_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as recordings, numbered in alphabetical order."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label")).distinct()
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label"))
    return segments.select(
        number.cast("int").alias("datum"), "label",
        F.lit(0).alias("start_frame"), F.lit(1.0).alias("time_interval_s"),
    )


def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "order_status", lambda: build_order_status(spark, sf_dir))


def build_order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as particles; fusion lies as many frames in as days since the customer's order before.

    A customer's first order never fuses.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = orders.withColumn("earlier", F.lag("o_orderdate").over(w))
    segments = broadcast_if_small(order_manifest(spark, sf_dir).select("datum", F.col("label").alias("c_mktsegment")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(segments, "c_mktsegment")
    days = F.datediff("o_orderdate", "earlier")
    return pairs.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "datum",
        F.col("o_orderkey").cast("int").alias("trace_num"),
        F.lit(True).alias("is_reviewed"),
        F.col("earlier").isNotNull().alias("is_fusion"),
        F.lit(0).alias("binding"),
        F.coalesce(days, F.lit(0)).alias("fusion_start"),
        F.coalesce(days, F.lit(0)).alias("fusion_end"),
        (F.col("o_custkey") % 10 == 0).alias("is_excluded"),
    )


def embedding_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short series: the values of one vector, grouped by label."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("label").alias("datum"), F.col("vec_id").cast("int").alias("trace_num"),
        F.posexplode("embedding").alias("pos", "v"),
    ).select("datum", "trace_num", (F.col("pos") + 1).alias("frame"), F.col("v").cast("double").alias("raw"))


def trace_list(samples: DataFrame) -> DataFrame:
    return trace_stats(samples).select("datum", "trace_num", "n")
