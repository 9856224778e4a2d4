"""Lookups, coverage joins and totals over objects(sha, pack_id, idx, offset, len, kind, size) and packs(id, state, ..)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.staging import spread


def live_objects(objects: DataFrame, packs: DataFrame) -> DataFrame:
    """Objects of live packs. The pack filter runs before the join; Spark broadcasts the pack ids only where they are small."""
    return objects.join(packs.where("state = 'live'").select(F.col("id").alias("pack_id")), "pack_id", "left_semi")


def live_lookup(ids: DataFrame, objects: DataFrame, packs: DataFrame) -> DataFrame:
    """Each id of ids(sha) with one live location (the copy of smallest pack, then idx) or nulls."""
    place = F.min(F.struct("pack_id", "idx", "offset", "len")).alias("at")
    live = live_objects(objects, packs).select("sha", "pack_id", "idx", "offset", "len")
    found = spread(live, "sha").join(ids.select("sha").distinct(), "sha", "left_semi").groupBy("sha").agg(place)
    return ids.join(found, "sha", "left").select("sha", "at.pack_id", "at.idx", "at.offset", "at.len")


def lookup_in_pack(ids: DataFrame, objects: DataFrame, packs: DataFrame, pack_id: int) -> DataFrame:
    """As live_lookup, falling back to a named pack that need not be live: (sha, pack_id)."""
    own = objects.where(F.col("pack_id") == pack_id).select("sha", F.col("pack_id").alias("own")).distinct()
    held = spread(live_objects(objects, packs).select("sha", "pack_id"), "sha").groupBy("sha").agg(F.min("pack_id").alias("pack_id"))
    return ids.select("sha").join(held, "sha", "left").join(own, "sha", "left").select("sha", F.coalesce("pack_id", "own").alias("pack_id"))


def missing_links(links: DataFrame, objects: DataFrame, packs: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct link targets that are neither live nor in the batch own(sha)."""
    known = live_objects(objects, packs).select("sha").unionAll(own.select("sha"))
    return links.select(F.col("dst").alias("sha")).distinct().join(known, "sha", "left_anti")


def known_ids(ids: DataFrame, objects: DataFrame, packs: DataFrame) -> DataFrame:
    return ids.join(live_objects(objects, packs), "sha", "left_semi")


def unknown_ids(ids: DataFrame, objects: DataFrame, packs: DataFrame) -> DataFrame:
    return ids.join(live_objects(objects, packs), "sha", "left_anti")


def pack_coverage(ids: DataFrame, objects: DataFrame, packs: DataFrame) -> DataFrame:
    """Per live pack: how many of ids it holds, and whether it holds all."""
    wanted = ids.select("sha").distinct()
    held = live_objects(objects, packs).join(wanted, "sha", "left_semi").groupBy("pack_id").agg(F.countDistinct("sha").alias("held"))
    return held.join(F.broadcast(wanted.agg(F.count(F.lit(1)).alias("wanted")))).select("pack_id", "held", (F.col("held") == F.col("wanted")).alias("covers_all"))


def orphan_packs(packs: DataFrame, pushes: DataFrame, now: int, age: int = 3_600_000) -> DataFrame:
    """Ingesting packs older than age whose push is not open."""
    old = packs.where((F.col("state") == "ingesting") & F.col("push_id").isNotNull() & (F.col("created_at") < now - age))
    return old.join(pushes.where("state = 'open'").select(F.col("id").alias("push_id")), "push_id", "left_anti").select("id", "push_id")


def rejected_push_packs(packs: DataFrame, pushes: DataFrame) -> DataFrame:
    lost = pushes.where(F.col("state").isin("rejected", "expired")).select(F.col("id").alias("push_id"), F.col("state").alias("push_state"))
    return packs.where("state = 'ingesting'").join(lost, "push_id").select("id", "push_id", "push_state")


def deletable_packs(packs: DataFrame, objects: DataFrame, now: int, grace: int = 3_600_000) -> DataFrame:
    """Packs that died longer ago than the grace and that no index row names."""
    return packs.where((F.col("state") == "dead") & (F.col("dead_at") < now - grace)).join(objects.select(F.col("pack_id").alias("id")), "id", "left_anti").select("id")


def retirable_entries(objects: DataFrame, packs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Entries of cohort(id) packs, with `elsewhere`: another live pack outside the cohort holds the object."""
    ids = cohort.select(F.col("id").alias("pack_id"))
    outside = live_objects(objects, packs).join(ids, "pack_id", "left_anti").select("sha").distinct().withColumn("elsewhere", F.lit(True))
    mine = objects.join(ids, "pack_id", "left_semi").select("sha", "pack_id", "idx")
    return mine.join(outside, "sha", "left").select("sha", "pack_id", "idx", F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"))


def storage_totals(packs: DataFrame, push_id: int | None = None) -> DataFrame:
    """Objects and bytes of live packs and of one push's ingesting packs."""
    counted = F.col("state") == "live"
    if push_id is not None:
        counted = counted | ((F.col("state") == "ingesting") & (F.col("push_id") == push_id))
    return packs.where(counted).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def state_counts(table: DataFrame, column: str = "state") -> DataFrame:
    return table.groupBy(F.col(column).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def pack_self_check(objects: DataFrame, packs: DataFrame) -> DataFrame:
    """Index rows and distinct objects of each pack against its declared count."""
    rows = objects.groupBy(F.col("pack_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sha").alias("n_distinct"))
    counts = packs.select("id", "count").join(rows, "id", "left").fillna(0, ["n_rows", "n_distinct"])
    return counts.select("id", "n_rows", "n_distinct", (F.col("n_rows") == F.col("count")).alias("complete"), (F.col("n_distinct") < F.col("n_rows")).alias("repeats"))


def over_declared(objects: DataFrame, packs: DataFrame, declared: str = "count") -> DataFrame:
    """Packs with more index rows than declared: corrupt, two strikes at once."""
    rows = objects.groupBy(F.col("pack_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(packs, "id").where(F.col("n_rows") > F.col(declared)).select("id", "n_rows", F.lit(2).alias("strikes"))


def commit_bounds(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 1").groupBy("pack_id").agg(F.min("offset").alias("commit_lo"), F.max(F.col("offset") + F.col("len")).alias("commit_hi"))


def first_copies(objects: DataFrame, packs: DataFrame) -> DataFrame:
    """One live copy per object: min() of a struct pre-aggregates where a window would sort every copy."""
    at = F.min(F.struct("pack_id", "idx", "offset", "len", "kind", "size")).alias("at")
    return live_objects(objects, packs).groupBy("sha").agg(at).select("sha", "at.*")


def cohort_first_copies(objects: DataFrame, cohort: DataFrame) -> DataFrame:
    """The first copy, in pack order, of each object of cohort(id)."""
    mine = objects.join(cohort.select(F.col("id").alias("pack_id")), "pack_id", "left_semi")
    return mine.groupBy("sha").agg(F.min(F.struct("pack_id", "idx")).alias("at")).select("sha", "at.*")


def over_quota(packs: DataFrame, most_objects: int, most_bytes: int) -> DataFrame:
    """Owners (push_id) whose live packs exceed either quota."""
    used = packs.where("state = 'live'").groupBy("push_id").agg(F.count(F.lit(1)).alias("packs"), F.sum("count").alias("objects"), F.sum("bytes").alias("bytes"))
    return used.where((F.col("objects") > most_objects) | (F.col("bytes") > most_bytes))


def keyset_page(table: DataFrame, key: str, after, size: int) -> DataFrame:
    """Rows after a key in key order, a page of them (the page is the feature)."""
    return table.where(F.col(key) > after).orderBy(key).limit(size)


def region_commits(objects: DataFrame, needed: DataFrame, reach: int = 2 << 20) -> DataFrame:
    """Commits inside needed(pack_id, lo, hi), widened both ways."""
    return objects.where("kind = 1").join(needed, "pack_id").where((F.col("offset") >= F.col("lo") - reach) & (F.col("offset") < F.col("hi") + reach)).select("sha", "pack_id", "offset")


def global_duplicates(objects: DataFrame) -> DataFrame:
    """Bytes that one copy per object over all packs would save."""
    per = objects.groupBy("sha").agg(F.sum("len").alias("total"), F.max("len").alias("one"), F.count(F.lit(1)).alias("copies"))
    return per.agg(F.count(F.lit(1)).alias("objects"), F.sum("copies").alias("copies"), F.sum(F.col("total") - F.col("one")).alias("saved"))


def same_set(a: DataFrame, b: DataFrame, key: str = "sha") -> DataFrame:
    """Sizes of both key sets and of their differences."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    both = left.join(right, key, "full")
    return both.agg(F.count("l").alias("n_a"), F.count("r").alias("n_b"), F.count_if(F.col("r").isNull()).alias("only_a"), F.count_if(F.col("l").isNull()).alias("only_b"))


def ranked_prefix(table: DataFrame, order: list, size: str, most: int, *by: str) -> DataFrame:
    """Rows whose running size in the given order stays within a budget (hot sets, eviction)."""
    running = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("running", running).where(F.col("running") <= most)
