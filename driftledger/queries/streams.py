"""Streaming counterparts, run to the end over the events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.incremental import partition_sink, run_to_end, windowed
from . import query


def _folder(spark: SparkSession) -> str:
    """A fresh folder where all executors can write: the cluster's shared one, a temporary one in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="driftledger-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_tumbling_totals", "select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as decimal(28,4)) as total from events group by 1, 2")
def stream_tumbling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals a type; the last state of every window equals the batch result."""
    source = table(spark, sf_dir, "events")
    root = _folder(spark)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    totals = windowed(stream, "ts", ["event_type"], "1 day", "40 days").withColumn("day", F.col("window_start").cast("date")).drop("window_start")
    run_to_end(totals, f"{root}/checkpoint", partition_sink(f"{root}/out", ["day", "event_type"]))
    return spark.read.schema("n long, total decimal(28,4), day date, event_type string").parquet(f"{root}/out").select("day", "event_type", "n", "total")
