"""A stream gives what its batch form gives."""

from basalt.operators import refs
from basalt.plans.fixtures import view
from basalt.streaming import state


def test_cas_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    commands = view(spark, "/root/testdata/sf0.001", "g_commands").select("seq", "name", "old", "new")
    for i in range(3):  # three files in order, three triggers
        commands.where(f"seq div 400 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.cas_stream(state.log_stream(spark, str(tmp_path / "in"), commands, files=1))
    got = state.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {tuple(r) for r in got.select("name", "seq", "accepted").collect()} == {tuple(r) for r in refs.cas_fold(commands).select("name", "seq", "accepted").collect()}


def test_minute_counts_close_with_the_watermark(spark, tmp_path):
    from pyspark.sql import functions as F

    events = view(spark, "/root/testdata/sf0.001", "events").select((F.col("user_id") % 3).alias("bucket"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.minute_counts(state.log_stream(spark, str(tmp_path / "in"), events), minute="1 hour")
    got = state.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    batch = {tuple(r) for r in events.groupBy("bucket", F.window("ts", "1 hour").alias("w")).count().select("bucket", "w.start", "count").collect()}
    closed = {tuple(r) for r in got.collect()}
    assert closed <= batch and len(closed) >= len(batch) - 9
