"""Rules at their boundaries, stated by hand, and walks and folds whose cost must not grow with depth or with one name's length."""

import random
import time

from pyspark.sql import functions as F

from basalt.functions.folds import running_total
from basalt.operators import admin, bitmaps, catalog, graph, jobs, packs, refs


def test_tiers_open_at_their_bounds(spark):
    counts = spark.createDataFrame([(n,) for n in (1, 7, 8, 127, 128, 2047, 2048, 32767, 32768)], "count long")
    assert [r.tier for r in counts.withColumn("tier", packs.tier_of(F.col("count"))).orderBy("count").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_backoff_and_strands(spark):
    rows = [(i, "running", 0, a, s, 7) for i, (a, s) in enumerate([(0, 0), (1, 62), (5, 63), (6, 64), (7, 65)])]
    table = spark.createDataFrame(rows, "id long, state string, started_at long, attempts int, strands int, run_at long")
    assert [(r.state, r.run_at) for r in jobs.after_failure(table, 0).orderBy("id").collect()] == [("queued", 60_000), ("queued", 120_000), ("queued", 1_920_000), ("queued", 3_600_000), ("dead", None)]
    assert [(r.state, r.run_at, r.strands) for r in jobs.repaired(table, 100_000).orderBy("id").collect()] == [("queued", 100_000, 1), ("queued", 100_000, 63), ("queued", 100_000, 64), ("dead", 7, 64), ("dead", 7, 65)]


def test_an_old_pack_that_just_died_stays(spark):
    table = spark.createDataFrame([(1, "dead", 0, 9_000_000), (2, "dead", 0, 5_000_000), (3, "live", 0, None)], "id long, state string, created_at long, dead_at long")
    assert [r.id for r in catalog.deletable_packs(table, spark.createDataFrame([], "pack_id long"), 10_000_000).collect()] == [2]


def test_the_257th_pin_is_refused(spark):
    refs_ = spark.range(400).selectExpr("concat('refs/heads/b', id) name", "cast(id as string) target")
    pins = refs_.where("cast(target as int) < 250").selectExpr("name", "target sha")
    asks = refs_.where("cast(target as int) >= 249").selectExpr("cast(target as long) seq", "name", "target sha")
    got = {r.name for r in admin.pinned(asks, refs_, pins).collect()}
    assert len(got) == 256 and "refs/heads/b255" in got and "refs/heads/b256" not in got
    assert admin.unpinned(pins, pins.where("sha < '2'")).count() == pins.where("sha >= '2'").count()


def test_pushes_at_the_pack_cap_are_busy_but_begin_again(spark):
    held = spark.createDataFrame([(1, "open", "p", "t")], "id long, state string, principal string, auth string")
    asks = spark.createDataFrame([(1, 1, "p", "t"), (2, 2, "p", "t")], "seq long, push_id long, principal string, auth string")
    table = spark.createDataFrame([(1, "live"), (2, "ingesting"), (3, "dead")], "id long, state string")
    assert {r.push_id: r.verdict for r in admin.begun_pushes(asks, held, table, 2).collect()} == {1: "again", 2: "busy"}
    assert {r.push_id: r.verdict for r in admin.begun_pushes(asks, held, table, 3).collect()} == {1: "again", 2: "open"}


def test_a_single_full_pack_is_not_repacked(spark):
    objects = spark.createDataFrame([("a", 1, 0, 5), ("b", 1, 1, 7), ("c", 2, 0, 9)], "sha string, pack_id long, idx long, len long")
    one, every = spark.createDataFrame([(1,)], "id long"), objects.select("sha")
    assert packs.consolidated(objects, one, every).count() == 0
    assert [tuple(r) for r in packs.consolidated(objects, one, every.where("sha = 'b'")).collect()] == [("b", 1, 1, 0)]
    assert sorted(tuple(r) for r in packs.consolidated(objects, one.unionAll(one.selectExpr("id + 1")), every).collect()) == [("a", 1, 0, 0), ("b", 1, 1, 5), ("c", 2, 0, 12)]


def test_bitmaps_round_trip(spark):
    rng = random.Random(1)
    table = spark.createDataFrame([(1, 1), (2, 8), (3, 33), (4, 64), (5, 100)], "id long, count long")
    bits = sorted({(i, rng.randrange(n)) for i, n in ((1, 1), (3, 33), (4, 64), (5, 100)) for _ in range(n // 2 + 1)} | {(2, i) for i in range(8)})
    marks = spark.createDataFrame([*bits, bits[0], (1, 5)], "id long, idx long")
    maps = bitmaps.bitmaps(table, marks)
    assert {r.id: len(r.bitmap) for r in maps.collect()} == {1: 1, 2: 1, 3: 5, 4: 8, 5: 13}
    assert sorted(tuple(r) for r in bitmaps.entries(maps).collect()) == bits


def test_running_totals_across_blocks(spark):
    rows = [(i * 7, i % 5) for i in range(500)]
    got = {r.at: r.before for r in running_total(spark.createDataFrame(rows, "at long, v long"), "at", "v", fan=8).collect()}
    assert got == {at: sum(v for a, v in rows if a < at) for at, _ in rows}


def test_a_chain_of_20000_commits_is_walked_in_few_rounds(spark):
    n = 20_000
    parents = spark.range(1, n).selectExpr("cast(id as string) sha", "0 n", "cast(id - 1 as string) parent").unionAll(spark.range(n).selectExpr("cast(id as string)", "-1", "cast(null as string)"))
    tip = spark.createDataFrame([(str(n - 1),)], "sha string")
    begun = time.time()
    got = graph.first_parents(tip, parents).agg(F.count("*"), F.max("pos"), F.sum(F.col("pos") + F.col("sha").cast("long"))).first()
    assert tuple(got) == (n, n - 1, n * (n - 1))
    assert time.time() - begun < 60
    assert graph.depth_cut(tip, parents, 15_000).where("shallow").select("sha", "depth").collect() == [(str(n - 15_000), 15_000)]
    pairs = spark.createDataFrame([("3", str(n - 1)), (str(n - 1), "3")], "old string, new string")
    assert {r.old: r.is_ff for r in graph.fast_forward(pairs, parents).collect()} == {"3": True, str(n - 1): False}
    assert {r.old: r.is_ff for r in graph.fast_forward(pairs, parents, most=1000).collect()} == {"3": True, str(n - 1): False}
    assert graph.fast_forward(spark.createDataFrame([("x", str(n - 1))], "old string, new string"), parents, most=1000).first().is_ff is None
    numbered = graph.generations(parents, parents.select("sha").distinct())
    assert numbered.where("gen <> cast(sha as int) + 1").count() == 0 == numbered.count() - n


def test_deep_graphs_with_branches_and_cycles(spark):
    rng = random.Random(2)
    edges = {(i, max(0, i - rng.choice((1, 1, 1, 2, 3)))) for i in range(1, 300) for _ in range(2)}
    links = spark.createDataFrame([(str(a), str(b)) for a, b in edges if a != b], "src string, dst string")
    depth, level = {299: 1}, [299]
    while level:
        level = sorted({b for a, b in edges if a in level and b not in depth})
        depth.update({b: max(depth.values()) + 1 for b in level})
    got = {int(r.sha): r.depth for r in graph.levels(spark.createDataFrame([("299",)], "sha string"), links).collect()}
    assert got == depth and max(depth.values()) > graph.PLAIN
    ring = spark.createDataFrame([(str(i), str((i + 1) % 100)) for i in range(100)], "src string, dst string")
    assert graph.levels(spark.createDataFrame([("5",)], "sha string"), ring).count() == 100


def test_one_name_with_very_many_commands(spark):
    n = 300_000
    commands = spark.range(n).selectExpr("'refs/heads/a' name", "id seq", "cast(nullif(id - 1, -1) as string) old", "cast(id as string) new")
    begun = time.time()
    assert refs.cas_fold(commands).where("accepted").count() == n
    assert time.time() - begun < 60
