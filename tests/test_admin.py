"""Administration and shallow history: the SQL twins' rows, a plain walk, and hand-made cases."""

import glob
import os

import duckdb
import pytest

from basalt.operators import admin, history
from basalt.plans import admin_queries as plans

DATA = "/root/testdata/sf0.001"
SPARK, DUCK = plans.spark_queries(), plans.duck_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(DUCK))
def test_same_rows(spark, duck, name):
    got = SPARK[name](spark, DATA).toArrow()
    want = duck.sql(DUCK[name])
    columns = sorted(got.column_names)
    assert columns == sorted(want.columns)
    mine = sorted(zip(*[got.column(c).to_pylist() for c in columns], strict=True), key=repr)
    theirs = sorted([tuple(r[list(want.columns).index(c)] for c in columns) for r in want.fetchall()], key=repr)
    assert mine == theirs


def plain_walk(tips, parents, own, acks, depth, relative):
    """One queue, level by level, over dicts."""
    level, seen = {t: (1, relative) for t in tips}, {}
    passed = set()
    while level:
        after = {}
        for c, (d, free) in level.items():
            seen[c] = d
            through = c in own and (relative or d < depth)
            if through:
                passed.add(c)
            elif c in own or (not free and d >= depth):
                continue
            ahead = (1 if relative else d + 1, False) if through else (d + 1, free)
            for p in parents.get(c, []):
                after[p] = min(after.get(p, (ahead[0], ahead[1])), ahead, key=lambda x: (x[1], x[0]))
        level = {c: v for c, v in after.items() if c not in seen}
    client = (set(seen) - own - acks) | own | acks
    lacks = {c for c in seen if any(p not in client for p in parents.get(c, []))}
    say = lambda c: ("shallow" if c in lacks else "send") if c not in own | acks else ("unshallow" if c in passed and c not in lacks else "held")
    return {(c, d, say(c)) for c, d in seen.items()}


@pytest.mark.parametrize("name, depth, relative", [("relative_depth", 2, True), ("deepen_shallow", 5, False)])
def test_walks_of_shallow_clients(spark, name, depth, relative):
    up = {}
    for k in range(1, 1500):
        up[str(k)] = [str(k // 2)] + ([str(k // 3)] if k % 5 == 0 and k > 2 else [])
    want = plain_walk(["1440", "1296"], up, {"360", "162", "144"}, {"720"}, depth, relative)
    assert {(r.sha, r.depth, r.outcome) for r in SPARK[name](spark, DATA).collect()} == want


def test_depth_restarts_below_the_old_boundary(spark):
    """Chain e-d-c-b-a, the client holds c as its boundary: one more commit below it, and all above."""
    parents = spark.createDataFrame([(s, 0, p) for s, p in zip("edcb", "dcba")], "sha string, n int, parent string")
    one = lambda t: spark.createDataFrame([(c,) for c in t], "sha string")
    got = {(r.sha, r.depth, r.outcome) for r in history.deepened(one("e"), parents, one("c"), 1, relative=True).collect()}
    assert got == {("e", 1, "send"), ("d", 2, "send"), ("c", 3, "unshallow"), ("b", 1, "shallow")}
    assert history.deepened(one(""), parents, one("c"), 1).count() == 0


def test_tags_in_a_cycle_have_no_row(spark):
    tags = spark.createDataFrame([("a", "b"), ("b", "a"), ("t", "u"), ("u", "c")], "sha string, target string")
    ids = spark.createDataFrame([("a",), ("t",), ("c",)], "sha string")
    assert {tuple(r) for r in history.peeled(tags, ids).collect()} == {("t", "c", 2), ("c", "c", 0)}


def test_large_files_for_upload(spark):
    asks = spark.createDataFrame([("a" * 64, 1), ("b" * 64, 2), ("zz", 3), (None, 4)], "oid string, size long")
    stored = spark.createDataFrame([("a" * 64,)], "oid string")
    got = {(r.size, r.action, r.error) for r in admin.large_files(asks, stored, True).collect()}
    assert got == {(1, None, None), (2, "upload", None), (3, None, 422), (4, None, 422)}


def test_too_many_patterns(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        admin.covered(F.lit("refs/heads/a"), ["refs/x*"] * 65)
