"""Hand-made graphs with known answers."""

import pytest

from basalt.operators import graph


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def diamond(spark):
    """d has parents b and c, both have a; e is unrecorded."""
    edges = [("d", 0, "b"), ("d", 1, "c"), ("b", 0, "a"), ("c", 0, "a"), ("f", 0, "e")]
    return frame(spark, edges + [(s, -1, None) for s in "abcdf"], "sha string, n int, parent string")


def ids(spark, text):
    return frame(spark, [(c,) for c in text], "sha string")


def test_diamond_reachability(spark, diamond):
    links = graph.parent_links(diamond)
    assert {r.sha for r in graph.reachable(ids(spark, "d"), links).collect()} == set("abcd")
    assert {r.sha for r in graph.send_set(ids(spark, "d"), ids(spark, "b"), links).collect()} == set("cd")


def test_fast_forward_is_three_valued(spark, diamond):
    pairs = frame(spark, [("a", "d"), ("d", "d"), ("d", "b"), ("a", "f")], "old string, new string")
    assert {(r.old, r.new): r.is_ff for r in graph.fast_forward(pairs, diamond).collect()} == {("a", "d"): True, ("d", "d"): True, ("d", "b"): False, ("a", "f"): None}


def test_depth_and_boundary(spark, diamond):
    assert {(r.sha, r.depth, r.shallow) for r in graph.depth_cut(ids(spark, "d"), diamond, 2).collect()} == {("d", 1, False), ("b", 2, True), ("c", 2, True)}


def test_criss_cross_has_two_bases(spark):
    edges = [("x", 0, "p"), ("x", 1, "q"), ("y", 0, "q"), ("y", 1, "p"), ("p", 0, "r"), ("q", 0, "r")]
    parents = frame(spark, edges, "sha string, n int, parent string")
    assert {r.sha for r in graph.merge_base(ids(spark, "x"), ids(spark, "y"), parents).collect()} == {"p", "q"}


def test_delta_cycles_and_gaps_stay_unresolved(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")]
    assert {r.id: r.level for r in graph.delta_levels(frame(spark, rows, "id string, base string")).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_cycles_end_and_empty_roots(spark):
    links = frame(spark, [("a", "b"), ("b", "a")], "src string, dst string")
    assert {r.sha for r in graph.reachable(ids(spark, "a"), links).collect()} == {"a", "b"}
    assert graph.reachable(frame(spark, [], "sha string"), links).count() == 0


def test_shallow_histories_are_numbered_layer_by_layer_and_deep_ones_by_doubling(spark, monkeypatch):
    import random

    rng, edges = random.Random(3), []
    for k in range(1, 300):
        edges += [(str(k), n, str(p)) for n, p in enumerate({rng.randrange(k // 2, k) if k < 12 else rng.randrange(k // 3, k // 2 + 1) for _ in range(2)})]
    edges += [("7", 2, "unknown"), ("8", 3, "7"), ("8", 4, "7")]
    parents, commits = frame(spark, edges, "sha string, n int, parent string"), frame(spark, [(str(k),) for k in [*range(300), 5, 5]], "sha string")
    want = {}
    for k in range(300):
        want[str(k)] = 1 + max((want[p] for s, _, p in edges if s == str(k) and p in want), default=0)
    real = graph.jumps
    monkeypatch.setattr(graph, "jumps", lambda *_: pytest.fail("a shallow history was doubled"))
    assert {r.sha: r.gen for r in graph.generations(parents, commits).collect()} == want and 8 < max(want.values()) < 40
    monkeypatch.setattr(graph, "jumps", real)
    monkeypatch.setattr(graph, "LAYERS", 3)
    got = graph.generations(parents, commits).collect()
    assert len(got) == 300 and {r.sha: r.gen for r in got} == want


def test_walks_are_the_same_with_small_and_large_frontiers(spark, monkeypatch):
    """Frontiers that are sent to the links and links filed by source find what a plain walk finds, with keys, stops and cycles."""
    import random

    rng = random.Random(8)
    edges = list({(rng.randrange(120), rng.randrange(160)) for _ in range(150)}) + [(118, 118)]
    links = frame(spark, [(str(a), str(b)) for a, b in edges], "src string, dst string")

    def plain(root, stop):
        depth, at = {}, {root} - stop
        while at:
            depth |= {x: len(depth) and 1 + max(depth.values()) or 1 for x in at}
            at = {b for a, b in edges if a in at} - depth.keys() - stop
        return depth

    roots = frame(spark, [("a", "1"), ("a", "1"), ("b", "2"), ("c", "150"), ("d", "118")], "key string, sha string")
    for small in (100_000, 3, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        for stop in ({5, 40, 41, 118}, set()):
            got = graph.levels(roots, links, stop=frame(spark, [(str(x),) for x in stop], "sha string") if stop else None, keys=("key",)).collect()
            want = {(k, str(x), d) for k, r in (("a", 1), ("b", 2), ("c", 150), ("d", 118)) for x, d in plain(r, stop).items()}
            assert len(got) == len(want) and {(r.key, r.sha, r.depth) for r in got} == want


def test_small_frontiers_do_not_write_the_links(spark, monkeypatch):
    sizes, real = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: (lambda out: sizes.append(out.count()) or out)(real(df)))
    links = spark.range(5000).selectExpr("cast(id as string) as src", "cast(id div 2 as string) as dst")
    assert graph.reachable(ids(spark, "9"), links).count() == 5 and max(sizes) < 10
