"""Operators on documents against brute force, on a corpus of awkward rows."""

import re
from collections import Counter
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from basalt.llm import language_id, mixing, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup
from basalt.llm.common import NO_ID

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return NO_ID if row[0] is None else row[0]


def bag(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_quality_rules(docs, corpus, empty):
    def brute(text):
        text = text or ""
        ws = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        inside = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed

    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(got) == Counter((r[0], *brute(r[1])) for r in corpus)

    def verdict(text):
        """Shares of the word characters in lines after their first and in repeated n-grams of each length."""
        ws, inside = WORD.findall(text or ""), []
        seen, at = set(), 0
        for line in (text or "").split("\n"):
            n = len(WORD.findall(line))
            if n and line in seen:
                inside += range(at, at + n)
            seen.add(line)
            at += n
        total = max(1, sum(map(len, ws)))
        line_share, shares = sum(len(ws[i]) for i in inside) / total, {}
        for k in quality_rules.COVERAGE:
            grams = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
            hit = {j for i in range(len(ws) - k + 1) if grams[tuple(ws[i : i + k])] > 1 for j in range(i, i + k)}
            shares[k] = sum(len(ws[i]) for i in hit) / total
        kept = not brute(text)[5] and line_share <= quality_rules.LINE_COVERAGE and all(shares[k] <= v for k, v in quality_rules.COVERAGE.items())
        return kept, round(line_share, 9), round(max(shares.values()), 9)

    some = [r[1] for r in corpus] + ["\n".join(f"v{i % 70} is line {i % 23} of them" for i in range(k)) for k in (20, 30, 45)] + [" ".join(f"t{i % 61}" for i in range(k)) for k in (70, 85, 100)]
    judged = quality_rules.quality_rules(docs.sparkSession.createDataFrame(list(enumerate(some)), "doc_id int, text string")).collect()
    assert {r.doc_id: (r.kept, round(r.line_coverage, 9), round(r.ngram_coverage, 9)) for r in judged} == {i: verdict(t) for i, t in enumerate(some)}
    assert quality_rules.quality_rules(docs).where("kept and base_failed").count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_unlike_items_of_one_hash_are_told_apart():
    import numpy as np

    from basalt.llm.common import repeated

    items = np.array([3, 5, 3, 7, 5])
    got = repeated(np.zeros(5, np.uint64), lambda i, j: bool((items[i] == items[j]).all()), lambda: items)
    assert [m.tolist() for m in got] == [[True, True, True, False, True], [False, False, True, False, True]]


def components(items, linked):
    root = list(range(len(items)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


@pytest.mark.parametrize("radius", [4, 14])
def test_simhash_components(docs, corpus, empty, radius):
    def brute(text):
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not ws:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [brute(r[1]) for r in corpus]
    group = components(prints, lambda a, b: (a ^ b).bit_count() <= radius)
    least = {g: min(key(r) for r, h in zip(corpus, group, strict=True) if h == g) for g in set(group)}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(corpus, prints, group, strict=True))
    got = simhash_dedup.simhash_components(docs, shingle=4, radius=radius).drop("tag").fillna(NO_ID, ["component_id"])
    assert bag(got) == want
    kept = simhash_dedup.first_of_each(docs, shingle=4, radius=radius)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash_dedup.simhash_components(empty).count() == 0 == simhash_dedup.first_of_each(empty).count()


def test_shards_find_every_link_whatever_their_number():
    for m in range(5, 8):
        masks = simhash_dedup.shard_masks(m, 4)
        for flips in ((0, 13, 26, 39), (1, 2, 3, 4), (12, 25, 38, 63), (9, 18, 27, 36)):
            change = sum(1 << f for f in flips)
            assert any(change & mask == 0 for mask in masks)


@pytest.mark.parametrize("bits", [20, 64])
def test_trees_find_all_within_the_radius(bits):
    import numpy as np

    values = np.unique(np.array([xxhash.xxh64_intdigest(str(i)) >> (64 - bits) for i in range(900)], np.uint64))
    np.random.default_rng(0).shuffle(values)
    tree = simhash_dedup.BKTree.unpacked(simhash_dedup.BKTree(values).packed())
    assert sorted(tree.value.tolist()) == sorted(values.tolist())
    query, found = tree.within(values[:300], 4)
    want = [(i, v) for i in range(300) for v in values.tolist() if (v ^ int(values[i])).bit_count() <= 4]
    assert sorted(zip(query.tolist(), found.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("limit", [0, simhash_dedup.BROADCAST])
def test_links_do_not_depend_on_the_size_of_trees_or_their_transport(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BROADCAST", limit)
    base = [xxhash.xxh64_intdigest(str(i)) for i in range(6)]
    values = sorted({base[i % 6] ^ (1 << i % 61) ^ (1 << (7 * i) % 64) for i in range(150)})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash_dedup.fingerprint_links(frame, 4, most=8).collect()
    group = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    joined = components(values, lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := {(r.u % (1 << 64), r.v % (1 << 64)) for r in links}) else None
    assert len(set(zip(group, joined, strict=True))) == len(set(group)) == len(set(joined)) and all((a ^ b).bit_count() <= 8 * 4 for a, b in pairs)


def test_substring_dedup(docs, corpus, empty):
    first = {}
    for r in corpus:
        ws = (r[1] or "").encode().split()
        for i in range(len(ws) - 49):
            w = tuple(ws[i : i + 50])
            first[w] = min(first.get(w, NO_ID), key(r))
    want = Counter()
    for r in corpus:
        ws = (r[1] or "").encode().split()
        gone = {j for i in range(len(ws) - 49) if first[tuple(ws[i : i + 50])] < key(r) for j in range(i, i + 50)}
        want[(key(r), len(ws), len(gone), sha256(b" ".join(w for j, w in enumerate(ws) if j not in gone)).hexdigest())] += 1
    got = substring_dedup.substring_dedup(docs, with_text=False).select("id", "n_symbols", "n_removed", "kept_sha256")
    assert bag(got) == want
    assert any(k[2] for k in want)
    assert substring_dedup.deduplicated(docs).columns == docs.columns
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 1])
def test_suffix_dedup(docs, corpus, empty, most):
    first = {}
    for r in corpus:
        b = (r[1] or "").encode()
        for i in range(len(b) - 99):
            first[b[i : i + 100]] = min(first.get(b[i : i + 100], (NO_ID, NO_ID)), (key(r), i))
    want = Counter()
    for r in corpus:
        b = (r[1] or "").encode()
        gone = {j for i in range(len(b) - 99) if first[b[i : i + 100]] < (key(r), i) for j in range(i, i + 100)}
        runs = sum(j - 1 not in gone for j in gone)
        want[(key(r), len(b), len(gone), runs, sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest())] += 1
    got = suffix_dedup.suffix_dedup(docs, with_text=False, most=most).select("id", "n_symbols", "n_removed", "n_spans", "kept_sha256")
    assert bag(got) == want
    assert suffix_dedup.suffix_dedup(empty, with_text=False).count() == 0


def test_run_length_index_orders_suffixes_and_matches():
    import numpy as np

    parts = [b"abracadabra", b"abracad", b"zzzz", b"", b"cadabra"]
    index = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    suffixes = sorted((p[i:] + b"\0", n, i) for n, p in enumerate(parts) for i in range(len(p) + 1))
    assert [(n, i) for _, n, i in suffixes] == [(int(np.searchsorted(index.starts, o, "right") - 1), int(o - index.starts[np.searchsorted(index.starts, o, "right") - 1])) for o in index.order]
    string, place, least = index.earliest(4, np.arange(len(parts)) * 100)
    brute = [(n, i, min(100 * m + j for m, q in enumerate(parts) for j in range(len(q) - 3) if q[j : j + 4] == p[i : i + 4])) for n, p in enumerate(parts) for i in range(len(p) - 3)]
    assert sorted(zip(string.tolist(), place.tolist(), least.tolist(), strict=True)) == brute


def test_packing(docs, corpus, empty):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    # a text that holds the string of an added token goes to its id, as tokenizers does
    special = (77, "a <|endoftext|> b", "en", "src1", 1, 1, True, 1, "d")
    docs = docs.unionAll(docs.sparkSession.createDataFrame([special], docs.schema))
    want = Counter()
    for r in [*corpus, special]:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for i, n in enumerate([x for x in (len(ids) % 2048, *[2048] * (len(ids) // 2048)) if x]):
            want[(r[0], i, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    rows = packing.pack(docs, with_ids=False).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(empty).count() == 0


def test_crossover_keeps_every_item_once():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 300).tolist()
    bins, loads = packing.evolve(sizes, 2048, 3)[0]
    assert packing.decoded(packing.encoded((bins, loads), 300), sizes)[1] == loads
    assert sorted(x for b in bins for x in b) == list(range(300)) and all(sum(sizes[x] for x in b) == n <= 2048 for b, n in zip(bins, loads, strict=True))
    child = packing.crossover((bins, loads), packing.evolve(sizes, 2048, 9)[-1], sizes, 2048, rng)
    assert sorted(x for b in child[0] for x in b) == list(range(300))


def test_the_genetic_algorithm_needs_fewer_bins_than_best_fit_decreasing(spark):
    """Lengths of a quarter to half a sequence: best-fit decreasing (no generations) wastes room that crossovers win back."""
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(shard, 1000 * shard + i, int(n)) for shard in range(4) for i, n in enumerate(rng.integers(500, 1001, 250))]
    items = spark.createDataFrame(rows, "shard long, item long, length long")
    used = {g: [len(set(np.frombuffer(r.grouping, np.int32))) for r in packing.best_groupings(items, 2048, g).orderBy("shard").collect()] for g in (0, packing.GENERATIONS)}
    assert all(a < b for a, b in zip(used[packing.GENERATIONS], used[0], strict=True))


def test_elites_migrate_and_breed_elsewhere(spark):
    sizes = [700, 650, 640, 700, 690, 655, 1000, 30, 500, 999]
    best = packing.encoded(packing.evolve(sizes, 2048, 1)[0], len(sizes))
    islands = spark.createDataFrame([(0, 0, sizes, [best])], "shard long, island int, sizes array<long>, population array<binary>")
    assert bytes(packing.epoch(islands, 2048, 1, 4).first().population[0]) == best


def test_language_id(spark, docs, empty):
    rows = [(i, ("der und die schule haus wald " if i % 2 else "the and house forest school ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(200)]
    known = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (None, "the house", None), (902, "q", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(known).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred, got[None].lang_pred) == ("und", 0.0, "und", "en")
    assert got[902].lang_pred in ("de", "en")
    assert language_id.language_id(docs).count() == docs.count()
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() >= 0.98 * both.count()


def test_quality_classifier(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = quality_classifier.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    assert both.where("quality = predicted").count() >= 0.95 * both.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.quality_scores(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality_classifier.quality_scores(docs, odd).where("score between 0 and 1").count() == docs.count()
    assert quality_classifier.quality_scores(empty, odd).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs, keep_columns=["doc_id"], share=0.6)
    assert got.where("n_copies < 1 or n_copies > 4").count() == 0 < got.count()
    total = mixing.mix(docs, keep_columns=[], share=100.0).agg(F.sum(F.col("n_tokens") * F.col("n_copies"))).first()[0]
    # a budget beyond all supply reads everything max_epochs times
    assert total == 4 * docs.select(F.greatest(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)), F.lit(1)).alias("n")).agg(F.sum("n")).first()[0]
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0
