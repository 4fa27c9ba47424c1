"""Session-level helpers: the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcasting is allowed up to this many narrow rows (about 100 bytes each, so
# some 20 MB per executor).  Larger sides take the shuffle join.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a private temporary folder; a
    cluster session without it is an error, since executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spotrace-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used between stages whose result is read several times; the written table
    survives the loss of executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` has stored, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)
            del df.stored_at
            tidy(df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let the driver forget plans that nothing refers to; Spark then deletes the shuffle files they left."""
    gc.collect()
    spark._jvm.System.gc()


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table is proven to have at most ``max_rows`` rows.

    Counts no more than ``max_rows + 1`` rows, so pass tables that are cheap to
    read (a manifest, a stored box table), not a long derivation.
    """
    return not df.isStreaming and df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the side is proven small, else leave the join to Spark."""
    return F.broadcast(df) if is_small(df, max_rows) else df
