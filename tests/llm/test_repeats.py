"""Substring and suffix dedup where hashes, copies and crowded seeds could go wrong, against brute force and line by line counts."""

import random
from collections import Counter

import pytest

from basalt.llm import quality_rules, substring_dedup, suffix_dedup
from basalt.llm.common import keyed_texts
from basalt.llm.repeats import seeds


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n", [1024, 2048])
def test_strings_that_break_hashes_modulo_powers_of_two(spark, n):
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    head = [f"w{i}" for i in range(49)]
    lines = " ".join(head + ["end"]) + f"\n{one}\n{other}\n"
    docs = frame(spark, [" ".join([*head, one]), " ".join([*head, other]), lines])
    assert {r.id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0: 0, 1: 0, 2: 0}
    assert [r.n_dup_lines for r in quality_rules.quality_rules(docs).orderBy("doc_id").collect()] == [0, 0, 0]


def removed_words(texts):
    first = {}
    for i, t in enumerate(texts):
        ws = t.split()
        for k in range(len(ws) - 49):
            first.setdefault(tuple(ws[k : k + 50]), i)
    return {i: len({j for k in range(len(t.split()) - 49) if first[tuple(t.split()[k : k + 50])] < i for j in range(k, k + 50)}) for i, t in enumerate(texts)}


def test_one_passage_in_many_unlike_contexts(spark):
    """All documents share a seed; their contexts agree in pairs, triples and not at all, to either side."""
    rng = random.Random(3)
    core = [f"c{i}" for i in range(38)]
    texts = []
    for _ in range(80):
        g, h = rng.randrange(3), rng.randrange(3)
        left = [f"s{g}-{j}" for j in range(rng.randrange(20))] + [f"x{rng.randrange(9)}-{j}" for j in range(rng.randrange(9))]
        right = [f"t{h}-{j}" for j in range(rng.randrange(20))] + [f"y{rng.randrange(9)}-{j}" for j in range(rng.randrange(9))]
        texts.append(" ".join([*left[::-1], *core, *right]))
    got = {r.id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, texts)).collect()}
    want = removed_words(texts)
    assert got == want and sum(map(bool, want.values())) > 10


def test_repeated_rows_cost_linearly(spark):
    """Anchors, diagonals and places per row do not grow with the number of its copies."""
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    made = []
    for k in (50, 100):
        docs = spark.createDataFrame([(1, base)] * k + [(2, base + " tail")], "doc_id long, text string")
        texts = keyed_texts(docs)
        diagonals = substring_dedup.met_anchors(seeds(texts, "word", 50, 25).drop("segment")).count()
        places, classes = suffix_dedup.routed(texts, 100, 32, 6000)
        made.append((diagonals, classes.count(), places.count() / (k + 1)))
    assert made[0][:2] == made[1][:2] and abs(made[0][2] - made[1][2]) < 2


def test_indexes_decide_every_removal(spark, docs):
    """Whole copies and crowded seeds included: each removed byte lies in a range that an index returned."""
    texts = keyed_texts(docs)
    for most in (1, 6000):
        ranges = suffix_dedup.repeats(texts, most=most).distinct().collect()
        by = {}
        for r in ranges:
            by.setdefault((r.id, r.tag), set()).update(range(r.first, r.until))
        got = {(r.id, r.tag): r.n_removed for r in suffix_dedup.suffix_dedup(docs, with_text=False, most=most).where("n_removed > 0").collect()}
        assert {k: len(v) for k, v in by.items()} == got and Counter(got)


def test_rows_of_many_copies_come_back_as_often(spark, monkeypatch):
    """Copies are counted when texts are filed; the results of rows with more copies than a block are dealt out in blocks."""
    monkeypatch.setattr("basalt.llm.repeats.COPIES", 2)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] + [(2, text)] * 5 + [(3, "a b")] * 2 + [(None, None)] * 3, "doc_id long, text string")
    for dedup, n in ((substring_dedup.substring_dedup, 60), (suffix_dedup.suffix_dedup, len(text))):
        rows = dedup(docs).collect()
        assert Counter(r.n_removed for r in rows) == {0: 6, n: 5} and Counter(r.n_symbols for r in rows)[0] == 3


def peak(work):
    """What work() returns, and how many bytes it held at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_deepening_holds_the_spans_of_a_batch_and_not_its_texts():
    import pyarrow as pa

    class Batches:
        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(5)
    n, size = 2000, 2000
    text = "".join(rng.choice("abcdef") for _ in range(3 * size))
    texts = [text[i : i + size] for i in (rng.randrange(2 * size) for _ in range(n))]
    spans = []
    for _ in range(n):
        first, windows = rng.randrange(size - 168), rng.randint(1, 69)
        spans.append([{"key": rng.randrange(2**62), "at": suffix_dedup.packed(first, windows, rng.randint(windows - 1, 68), 32)}])
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts), pa.array(spans, kind)], names=["id", "tag", "text", "spans"])
    run = suffix_dedup.deepened(Batches(), 100)
    rows = lambda made: sorted(r for b in made for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    whole, most = peak(lambda: list(run([batch])))
    assert most < 5 * n * size  # arrays over the texts' bytes took 100 times the texts
    one_by_one = rows(b for i in range(n) for b in run([batch.slice(i, 1)]))
    assert rows(whole) == one_by_one and len(one_by_one) > n


def test_index_of_the_largest_seed_is_small():
    import numpy as np

    rng = np.random.default_rng(6)
    m, seed = 3000, rng.integers(97, 123, 32)
    parts = [np.concatenate([rng.integers(97, 100, 68), seed, rng.integers(97, 100, 68)]).astype(np.uint8) for _ in range(m)]
    parts[1::9] = parts[::9]
    data, bounds = np.concatenate(parts), np.arange(m + 1) * 168
    (string, place, least), most = peak(lambda: suffix_dedup.RunLengthIndex(data, bounds).earliest(100, np.arange(m) << 40))
    assert len(string) == m * 69 and least.dtype == place.dtype == np.int64
    assert ((least >> 40) == np.where(string % 9 == 1, string - 1, string)).all() and ((least & (1 << 40) - 1) == place).all()
    assert most < 120 * (len(data) + m)  # with 64-bit places and ranks, over 150 bytes a symbol
