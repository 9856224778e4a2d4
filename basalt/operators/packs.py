"""Read planning and size-tiered compaction over packs(id, state, count, bytes, created_at) and their objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.folds import running_total, streamed_fold
from basalt.functions.staging import staged

#: Merge gap and span of a read; tier ladder of compaction.
GAP, SPAN = 256 << 10, 8 << 20
TIER_BASE, TIER_STEP, TIERS = 8, 16, 5


def merged_reads(entries: DataFrame, gap: int = GAP) -> DataFrame:
    """Neighbouring entries(pack_id, offset, len) merged while the gap between them is smaller: gaps and islands per pack."""
    w = Window.partitionBy("pack_id").orderBy("offset", "len")
    ends = entries.withColumn("end", F.col("offset") + F.col("len"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("offset") - reach >= gap), 1).otherwise(0)
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = ends.withColumn("fresh", fresh).withColumn("island", island).groupBy("pack_id", "island")
    return runs.agg(F.min("offset").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("entries")).drop("island")


def capped_reads(entries: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """merged_reads with a limit to a read's span, a greedy fold per pack; longer entries are read in fragments of the span."""
    spread = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("len") - 1) / span), F.lit(0)).cast("long"))
    parts = entries.withColumn("k", F.explode(spread)).select(
        "pack_id", (F.col("offset") + F.col("k") * span).alias("lo"), F.least(F.col("offset") + (F.col("k") + 1) * span, F.col("offset") + F.col("len")).alias("hi")
    )

    def reads():
        now: list = []

        def step(e):
            if now and e.lo - now[2] < gap and max(now[2], e.hi) - now[1] <= span:
                now[2] = max(now[2], e.hi)
                return []
            done = [tuple(now)] if now else []
            now[:] = [e.pack_id, e.lo, e.hi]
            return done

        step.end = lambda: [tuple(now)] if now else []
        return step

    return streamed_fold(parts, "pack_id", ["lo", "hi"], reads, "pack_id long, lo long, hi long")


def adaptive_reads(entries: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Packs whose plan has more reads than ceil(bytes / span) are merged again with the span as gap."""
    near = capped_reads(entries, gap, span)
    needed = entries.groupBy("pack_id").agg(F.ceil(F.sum("len") / span).alias("least"))
    sparse = near.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).join(needed, "pack_id").where("n > least").select("pack_id")
    return near.join(sparse, "pack_id", "left_anti").unionByName(capped_reads(entries.join(sparse, "pack_id", "left_semi"), span, span))


def tier_of(count: Column) -> Column:
    """Tiers by object count: [1, 8), [8, 128), [128, 2048), [2048, 32768) and beyond."""
    tier = F.lit(TIERS - 1)
    for i in range(TIERS - 2, -1, -1):
        tier = F.when(count < TIER_BASE * TIER_STEP**i, i).otherwise(tier)
    return tier


def eligible(packs: DataFrame, now: int, quarantined: DataFrame | None = None, min_age: int = 0, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    fit = packs.where((F.col("state") == "live") & F.col("count").between(1, max_rows // 2) & (F.col("bytes") < max_bytes) & (F.col("created_at") <= now - min_age))
    return fit.join(quarantined.select("id"), "id", "left_anti") if quarantined is not None else fit


def cohort(packs: DataFrame, trigger: int = 8, max_rows: int = 100_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Oldest packs of the fullest tier with enough packs: the longest prefix within 2 * trigger packs, rows and bytes; two at least.

    Only 2 * trigger packs per tier can matter. Ranking them within hashed groups first keeps windows small in a tier of any size.
    """
    tiers = packs.withColumn("tier", tier_of(F.col("count")))
    full = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= trigger).agg(F.max(F.struct("n", (-F.col("tier")).alias("low"))).alias("best"))
    chosen = tiers.join(F.broadcast(full.select((-F.col("best.low")).alias("tier"))), "tier", "left_semi")
    part = Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(4096))).orderBy("created_at", "id")
    oldest = chosen.withColumn("r", F.row_number().over(part)).where(F.col("r") <= 2 * trigger).orderBy("created_at", "id").limit(2 * trigger)
    w = Window.partitionBy("tier").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    kept = oldest.withColumn("rows_upto", F.sum("count").over(w)).withColumn("bytes_upto", F.sum("bytes").over(w))
    kept = kept.where((F.col("rows_upto") <= max_rows) & (F.col("bytes_upto") <= max_bytes)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("tier")))
    return kept.where("size >= 2").select("id", "tier", "count", "bytes")


def next_wake(packs: DataFrame, trigger: int = 8, min_age: int = 0) -> DataFrame:
    """When the trigger-th oldest pack of any tier comes of age."""
    part = Window.partitionBy("tier", F.pmod(F.xxhash64("id"), F.lit(4096))).orderBy("created_at", "id")
    oldest = packs.withColumn("tier", tier_of(F.col("count"))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= trigger)
    ranked = oldest.withColumn("n", F.row_number().over(Window.partitionBy("tier").orderBy("created_at", "id"))).where(F.col("n") == trigger)
    return ranked.agg(F.min(F.col("created_at") + min_age).alias("wake_at"))


def consolidated(objects: DataFrame, candidates: DataFrame, marked: DataFrame) -> DataFrame:
    """Marked entries of candidate packs in the order of (pack, idx), with their offset in the one new pack.

    Nothing is repacked unless there are two candidates or one of them has an unmarked entry: a single full pack stays as it is.
    """
    mine = objects.join(candidates.select(F.col("id").alias("pack_id")), "pack_id", "left_semi").select("sha", "pack_id", "idx", "len")
    mine = staged(mine.join(marked.select("sha", F.lit(1).alias("mark")).distinct(), "sha", "left"))  # three passes follow
    worth = mine.agg(F.min("pack_id").alias("a"), F.max("pack_id").alias("b"), F.count_if(F.col("mark").isNull()).alias("unmarked")).where("a < b or unmarked > 0").select(F.lit(1).alias("go"))
    kept = mine.where("mark is not null").join(F.broadcast(worth)).drop("go")
    before = F.sum("len").over(Window.partitionBy("pack_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    bases = running_total(kept.groupBy("pack_id").agg(F.sum("len").alias("kept")), "pack_id", "kept").select("pack_id", "before")
    return kept.join(bases, "pack_id").select("sha", "pack_id", "idx", (F.col("before") + F.coalesce(before, F.lit(0))).alias("new_offset"))


def swap_stats(objects: DataFrame, built: DataFrame) -> DataFrame:
    """Per pack, whether every entry is among built(sha); the totals of those that retire and of those that stay, and how many stay with entries missing from
    the new pack (lossy: retiring them would lose objects)."""
    has = built.select("sha").distinct().withColumn("built", F.lit(1))
    per = objects.join(has, "sha", "left").groupBy("pack_id").agg(F.count(F.lit(1)).alias("entries"), F.count("built").alias("built"), F.sum("len").alias("bytes"))
    full = F.col("entries") == F.col("built")
    return per.agg(F.count_if(full).alias("retired"), F.count_if(~full).alias("kept"), F.coalesce(F.sum(F.when(full, F.col("bytes"))), F.lit(0)).alias("retired_bytes"),
        F.coalesce(F.sum(F.when(~full, F.col("bytes"))), F.lit(0)).alias("kept_bytes"), F.count_if(~full & (F.col("built") > 0)).alias("lossy"))


def next_starts(entries: DataFrame) -> DataFrame:
    """Each entry's end and the next entry's start in its pack; a difference is a lost write."""
    after = F.lead("offset").over(Window.partitionBy("pack_id").orderBy("offset", "idx"))
    return entries.withColumn("next", after).select("pack_id", "idx", (F.col("offset") + F.col("len")).alias("until"), "next")
