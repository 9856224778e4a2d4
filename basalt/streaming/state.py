"""Structured Streaming forms of the queue and log operators; each gives what its batch form gives over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def log_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 64) -> DataFrame:
    """A Parquet folder as a stream, some files a trigger (backpressure)."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def minute_counts(events: DataFrame, lateness: str = "2 minutes", minute: str = "1 minute") -> DataFrame:
    """events(bucket, ts): tumbling counts; the watermark drops state of closed minutes."""
    return events.withWatermark("ts", lateness).groupBy("bucket", F.window("ts", minute).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("bucket", F.col("w.start").alias("start"), "n")


def unique_deliveries(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """events(delivery, ts): at-least-once input to one row per delivery key."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["delivery"])


def fold_commands(rows: Iterator[tuple], now: str | None) -> Iterator[tuple[int, bool, str | None]]:
    """(seq, old, new) in order -> (seq, accepted, target after it)."""
    for seq, old, new in rows:
        ok = old == now
        now = new if ok else now
        yield seq, ok, now


class RefLog(StatefulProcessor):
    """Compare-and-swap per ref name: the state is the current target; a trigger's commands are applied by seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.target = handle.getValueState("target", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq")
        null = lambda x: None if pd.isna(x) else x
        state = self.target.get() if self.target.exists() else (None,)
        out = list(fold_commands(((int(s), null(o), null(n)) for s, o, n in zip(got["seq"], got["old"], got["new"], strict=True)), null(state[0])))
        self.target.update((out[-1][2],))
        yield pd.DataFrame({"name": key[0], "seq": [o[0] for o in out], "accepted": [o[1] for o in out]})

    def close(self) -> None:
        pass


def cas_stream(commands: DataFrame) -> DataFrame:
    """commands(seq, name, old, new) -> (name, seq, accepted); needs the RocksDB state store."""
    return commands.groupBy("name").transformWithStateInPandas(RefLog(), "name string, seq long, accepted boolean", "Append", "None")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and read the result; a rerun continues from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
