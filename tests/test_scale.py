"""What one task sorts, and how often a table is read, does not grow with the input."""

from basalt.functions import staging
from basalt.operators import catalog, packs

OBJECTS = "sha string, pack_id long, idx long, offset long, len long"


def test_lookups_are_dealt_over_more_tasks_for_larger_tables(spark, monkeypatch, tmp_path):
    spark.range(20_000).selectExpr("sha1(cast(id % 7000 as string)) as sha", "id % 50 as pack_id", "id as idx", "id as offset", "1L as len").write.parquet(f"{tmp_path}/objects")
    objects, held = spark.read.parquet(f"{tmp_path}/objects"), spark.range(50).selectExpr("id", "case when id % 3 = 0 then 'live' else 'dead' end as state")
    ids = spark.range(7100).selectExpr("sha1(cast(id as string)) as sha")
    assert staging.spread(objects, "sha").rdd.getNumPartitions() == objects.rdd.getNumPartitions()
    plain = {tuple(r) for r in catalog.live_lookup(ids, objects, held).collect()}
    monkeypatch.setattr(staging, "PART", staging.bytes_of(objects) // 30)
    assert staging.spread(objects, "sha").rdd.getNumPartitions() >= 30
    assert {tuple(r) for r in catalog.live_lookup(ids, objects, held).collect()} == plain and len(plain) == 7100
    want = {r[0]: r[1] for r in plain}
    got = catalog.lookup_in_pack(ids, objects, held, 1).collect()
    assert len(got) == 7100 and all(r.pack_id == want[r.sha] if want[r.sha] is not None else r.pack_id in (1, None) for r in got)


def test_consolidation_reads_the_objects_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    objects = spark.range(60).selectExpr("cast(id % 40 as string) as sha", "id div 10 as pack_id", "id % 10 as idx", "id as offset", "id + 1 as len").mapInPandas(count, OBJECTS)
    marked = spark.range(0, 40, 2).selectExpr("cast(id as string) as sha")
    rows = packs.consolidated(objects, spark.createDataFrame([(1,), (3,), (4,)], "id long"), marked).orderBy("pack_id", "idx").collect()
    at = 0
    for r in rows:
        assert r.new_offset == at
        at += r.pack_id * 10 + r.idx + 1
    assert len(rows) == 15 and seen.value == 60
