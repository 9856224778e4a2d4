"""Streaming queries over the sample events, with the SQL of their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.staging import staging_folder
from basalt.streaming import state


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    return state.log_stream(spark, f"{sf_dir}/events.parq*t", like)


def _drain(stream: DataFrame) -> DataFrame:
    at = f"{staging_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return state.drain(stream, f"{at}/out", f"{at}/checkpoint")


def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).select(F.concat_ws(":", "user_id", F.col("event_id")).alias("delivery"), F.col("ts").cast("timestamp").alias("ts"))
    return _drain(state.unique_deliveries(events)).select("delivery")


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deletion events of the log, filtered on arrival."""
    return _drain(_stream(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id"))


QUERIES = {"stream_delivery_dedup": stream_deliveries, "stream_ref_deletions": stream_errors}
ORACLE_SQL = {
    "stream_delivery_dedup": "SELECT DISTINCT concat(CAST(user_id AS VARCHAR), ':', CAST(event_id AS VARCHAR)) AS delivery FROM events",
    "stream_ref_deletions": "SELECT event_id, user_id FROM events WHERE event_type = 'error'",
}
