"""The near-copy stage of the pipeline against brute force over five-word shingles."""

import random
import re
import time

import pytest

import corpus_pipeline
from basalt.llm import common, near_dedup
from basalt.llm.common import NO_ID

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows):
    """Sets of row numbers linked at 0.8 or more, by brute force."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, ws, n):
    ws = list(ws)
    for i in rng.sample(range(len(ws)), n):
        ws[i] = f"x{rng.randrange(10**6)}"
    return ws


@pytest.fixture(scope="module")
def rows():
    """Pairs of similarity 0.7 to 1, chains, ids that repeat with unlike texts, null ids with unlike texts, short and empty texts."""
    rng = random.Random(11)
    texts = []
    for k in range(48):
        base = words(rng, rng.randrange(200, 500))
        texts += [base, changed(rng, base, k % 8 * len(base) // 200)]
    chain = words(rng, 300)
    for _ in range(12):
        texts.append(chain)
        chain = changed(rng, chain, 4)
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "one two", "One  two", "three", texts[0][0].upper() + " " + " ".join(texts[0][1:])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(3, " ".join(words(rng, 120)), "de", "s", 1) for _ in range(3)] + [(None, " ".join(words(rng, 120)), "de", "t", 1) for _ in range(6)]
    return rows + [(None, rows[20][1], "de", "t", 1), rows[7], rows[7], (7, rows[7][1], "fr", "s", 1)]


def test_every_component_keeps_exactly_one_row_of_its_smallest_id(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    key = lambda r: NO_ID if r[0] is None else r[0]
    want = groups(rows)
    assert len(got) == len(want)
    for g in want:
        least = min(key(rows[i]) for i in g)
        assert any(rows[i] in got for i in g if key(rows[i]) == least)
    assert sum(r[0] is None for r in got) == 6 and sum(r[0] == 3 for r in got) >= 3
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_the_pipeline_stage_links_pairs_from_similarity_0_8(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 96], SCHEMA).dropDuplicates(["doc_id"])
    held = {r.doc_id: r.text for r in docs.collect()}
    gone = set(held) - {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    listed = [(i, t) for i, t in sorted(held.items())]
    assert gone == {listed[i][0] for g in groups(listed) for i in g[1:]}


def test_blocks_of_a_bucket_find_every_link_whatever_their_size(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert near_dedup.one_of_each(docs).count() == len(groups(rows))


def test_candidates_come_from_simhash_and_bk_trees(spark, rows, monkeypatch):
    """Without BK-trees there are no candidates; shards, blocks of shards and copies of a fingerprint lose no link."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "SHARD", 4)
    assert len(near_dedup.shard_masks(200)) > 10
    monkeypatch.setattr(near_dedup, "TREE", 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert near_dedup.one_of_each(docs).count() == len(groups(rows))
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    others = np.concatenate([base[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])  # similarity 450 / 550
    far = np.bitwise_count(near_dedup.simhash(base) ^ near_dedup.simhash(others)).sum()
    assert 5 < far <= near_dedup.RADIUS
    f0 = rng.integers(0, 2**63, 64, dtype=np.uint64)
    f0[40:44], f1 = f0[3], np.zeros(64, np.uint64)
    i, j = near_dedup.near_prints(f0, f1, np.arange(64), np.arange(64))
    want = {(a, b) for a in range(64) for b in range(64) if a != b and int(f0[a] ^ f0[b]).bit_count() <= near_dedup.NEAR}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def shuffle_files(spark):
    files, names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), set()
    while files.hasNext():
        names.add(files.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    was, df = spark.conf.get(key), spark.range(1000).selectExpr("id", "id AS tag", "id % 7 AS x").repartition(3, "x")
    written = [common.cut(df, "moved"), common.in_buckets(df)]
    for _ in range(20):
        if not (left := {n for n in shuffle_files(spark) - before if n.endswith(".data")}):
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(key) == was
    assert [t.count() for t in written] == [1000, 1000]


def test_stage_tables_are_small_beside_the_filed_rows(spark, monkeypatch, tmp_path):
    """Candidates, linked or not, add numbers to the disk, but neither their texts nor the hashes of their shingles."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng, texts = random.Random(4), []
    for k in range(60):
        base = words(rng, 1500)
        texts += [" ".join(base), " ".join(changed(rng, base, (15, 90)[k % 2]))]  # similarity 0.9 and 0.6
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert near_dedup.one_of_each(docs).count() == 90
    size = lambda of: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.relative_to(tmp_path).parts[0].startswith("texts_") == of)
    assert 0 < size(False) < size(True) / 2


def test_tables_that_are_dealt_apart_find_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARD", 16)
    monkeypatch.setattr(near_dedup, "TABLES", 5)
    assert len(near_dedup.shard_masks(150)) > 5
    assert near_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA)).count() == len(groups(rows))
