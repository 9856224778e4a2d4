"""Work queues: picking, backoff, repair, retention and rate limits as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the queue.
FIRST_WAIT, LONGEST_WAIT, DEAD_AFTER, STRANDED_AFTER, MOST_STRANDS = 30_000, 3_600_000, 8, 60_000, 64


def due_job(jobs: DataFrame, now: int) -> DataFrame:
    """The queued job that is due first (one job is the feature)."""
    return jobs.where((F.col("state") == "queued") & (F.col("run_at") <= now)).orderBy("run_at", "id").limit(1).select("id", "kind", "run_at")


def next_alarm(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'queued'").agg(F.min("run_at").alias("alarm_at"))


def after_failure(jobs: DataFrame, now: int) -> DataFrame:
    """Next state and wake-up after one more failure: exponential waits, the first a minute, dead after eight attempts."""
    attempt = F.col("attempts") + 1
    wait = F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.least(attempt, F.lit(20))).cast("long"), F.lit(LONGEST_WAIT))
    dead = attempt >= DEAD_AFTER
    return jobs.select("id", attempt.alias("attempts"), F.when(dead, "dead").otherwise("queued").alias("state"), F.when(~dead, F.lit(now) + wait).alias("run_at"))


def repaired(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs running for longer than a minute go back to the queue, due now, or die if they already were stranded 64 times."""
    stranded = (F.col("state") == "running") & (F.col("started_at") < now - STRANDED_AFTER)
    again = stranded & (F.col("strands") < MOST_STRANDS)
    state = F.when(again, "queued").when(stranded, "dead").otherwise(F.col("state"))
    return jobs.select("id", state.alias("state"), F.when(again, F.lit(now)).otherwise(F.col("run_at")).alias("run_at"), (F.col("strands") + again.cast("int")).alias("strands"))


def claimed(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(id, lease, at): the earliest claim of a queued job gets it and its lease; the others, and claims of other jobs, get nothing."""
    first = claims.groupBy("id").agg(F.min(F.struct("at", "lease")).alias("first"))
    got = jobs.where("state = 'queued'").join(first, "id")
    return got.select("id", F.lit("running").alias("state"), F.col("first.at").alias("started_at"), F.col("first.lease").alias("lease"))


def heartbeats(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """beats(id, lease, at): a beat counts only under the lease that runs the job; jobs with the time they were last seen, beats that are stale."""
    held = beats.join(jobs.where("state = 'running'").select("id", "lease", F.lit(True).alias("mine")), ["id", "lease"], "left")
    return held.select("id", "lease", "at", F.coalesce("mine", F.lit(False)).alias("counts"))


def landed(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """outcomes(id, lease, kind, run_at) of slices: done removes the job, continue and reschedule queue it with strands cleared, error queues it with backoff
    or kills it; only under the lease that runs the job, otherwise `stale`. Rows: id, outcome, and the job's next state (null if gone or not touched)."""
    held = outcomes.join(jobs.where("state = 'running'").select("id", "lease", "attempts"), ["id", "lease"], "left")
    mine, attempt = F.col("attempts").isNotNull(), F.col("attempts") + 1
    wait = F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.least(attempt, F.lit(20))).cast("long"), F.lit(LONGEST_WAIT))
    error, dead = F.col("kind") == "error", attempt >= DEAD_AFTER
    outcome = F.when(~mine, "stale").when(error & dead, "dead").when(error, "retry").otherwise(F.col("kind"))
    state = F.when(~mine | (F.col("kind") == "done"), None).when(error & dead, "dead").otherwise("queued")
    at = F.when(mine & (F.col("kind") == "continue"), F.lit(now)).when(mine & (F.col("kind") == "reschedule"), F.col("run_at")).when(mine & error & ~dead, F.lit(now) + wait)
    return held.select("id", outcome.alias("outcome"), state.alias("state"), at.alias("run_at"))


def one_per_kind(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'queued'").groupBy("kind").agg(F.min("id").alias("id"))


def quarantined(strikes: DataFrame, limit: int = 2, live: DataFrame | None = None, most: int = 256) -> DataFrame:
    """Packs with enough strikes. The list is kept to live(id) packs and to the `most` smallest ids (the bound is the list's own)."""
    found = strikes.groupBy("id").agg(F.sum("strikes").alias("strikes")).where(F.col("strikes") >= limit)
    return found if live is None else found.join(live.select("id").distinct(), "id", "left_semi").orderBy("id").limit(most)


def rate_refusals(events: DataFrame, limit: int, minute: int = 60_000) -> DataFrame:
    """events(bucket, id, at): refused if, counted with itself, this minute's count and the previous one's remaining share exceed the limit.

    Refused attempts count too. The previous minute is exactly the one before.
    """
    timed = events.withColumn("win", F.floor(F.col("at") / minute)).withColumn("n", F.row_number().over(Window.partitionBy("bucket", F.floor(F.col("at") / minute)).orderBy("at", "id")))
    last = timed.groupBy("bucket", (F.col("win") + 1).alias("win")).agg(F.count(F.lit(1)).alias("prev"))
    seen = timed.join(last, ["bucket", "win"], "left")
    estimate = F.col("n") + F.coalesce("prev", F.lit(0)) * (1 - F.pmod("at", F.lit(minute)) / F.lit(float(minute)))
    return seen.select("bucket", "id", (estimate > limit).alias("refused"))


def drained(outbox: DataFrame, failed: str = "failed") -> DataFrame:
    """outbox(lane, seq, failed): what is delivered before each lane's first failure."""
    first = outbox.where(F.col(failed)).groupBy("lane").agg(F.min("seq").alias("stop"))
    return outbox.join(first, "lane", "left").where("stop is null or seq < stop").select("lane", "seq")


def bounded_outbox(outbox: DataFrame, most: int) -> DataFrame:
    """Per lane, the first `most` pending events are stored, later ones counted (the bound is the feature)."""
    n = F.row_number().over(Window.partitionBy("lane").orderBy("seq"))
    return outbox.withColumn("stored", n <= most).groupBy("lane").agg(F.count_if("stored").alias("stored"), F.count_if(~F.col("stored")).alias("dropped"))


def next_stage(stages: DataFrame) -> DataFrame:
    """stages(run, seq, state): the first pending stage that no unfinished one precedes."""
    open_ = stages.where("state <> 'done'").groupBy("run").agg(F.min(F.struct("seq", "state")).alias("s"))
    return open_.where("s.state = 'queued'").select("run", F.col("s.seq").alias("seq"))


def tiers(touches: DataFrame, now: int, hot: int, cold: int, hot_most: int, cold_least: int) -> DataFrame:
    """touches(key, at, size) -> tier: small objects touched lately are hot, large ones not touched for long are cold, all others warm."""
    last = touches.groupBy("key").agg(F.max("at").alias("at"), F.max("size").alias("size"))
    is_hot, is_cold = (F.col("at") >= now - hot) & (F.col("size") <= hot_most), (F.col("at") < now - cold) & (F.col("size") >= cold_least)
    return last.select("key", F.when(is_hot, "hot").when(is_cold, "cold").otherwise("warm").alias("tier"))


def popular(fetches: DataFrame, since: int, k: int = 8) -> DataFrame:
    """The k keys fetched most since a time (top-k is the feature)."""
    return fetches.where(F.col("at") >= since).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(k)
