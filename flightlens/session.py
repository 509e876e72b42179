"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows up to which a lookup is sent whole to every executor: some 50 MB at 100 bytes a row.
BROADCAST_ROWS = 500_000


def get_session(app: str = "flightlens", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution.

    Only settings the results depend on, or that guard against skew, are set here; the cluster's own
    sizes (memory, cores, shuffle partitions) stay what the cluster says.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; if unset, one beside the warehouse, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For small derived tables that several later steps use: a daily series, a lookup. The table is
    computed once, outlives executors, and its real size is known to the optimizer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast if it has at most ``rows`` rows; otherwise joins with it shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def stored_lookup(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A derived lookup, computed once into a stored table, then checked for broadcast."""
    return checked_broadcast(stored(df, name), rows)
