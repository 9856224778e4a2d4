"""Near copies: documents whose sets of lower-cased five-word shingles have a Jaccard similarity of 0.8 or more.

Rows are first written in buckets of id and text hash, one of each; what follows moves keys and links, and texts of candidates alone:
a text is smaller than the hashes of its shingles, which are made anew where texts meet.

1. Each text gets a key of its shingle set and a SimHash of 128 bits: a bit is 1 if it is set in over half of the shingles' hashes.
   At a similarity of 0.8 a bit differs with probability acos(8 / 9) / pi = 0.151, so 19 of 128 bits do, with a deviation of 4.
2. Texts with equal sets collapse into one class. Classes are dealt into shards, in each of several tables by other bits of the
   SimHash, so that a shard holds SHARD classes or fewer in the mean. There are as many tables as it takes for a pair of
   similarity 0.8 to miss all of them with a probability of MISS; more similar pairs miss them less. TABLES of them are dealt at
   once, so that the disk they take grows no faster than the texts, though the number of tables grows with them.
3. A shard's fingerprints become BK-trees (of the first 64 bits, children keyed by Hamming distance), which its members search within
   NEAR bits; what is more than RADIUS bits apart over all 128 goes. What so hangs together in a tree is a bucket of candidates; a bucket found
   in several tables counts once.
4. Pairs of a bucket are verified by the exact similarity of the shingle sets; only verified pairs are links. First each class meets
   the smallest class of its buckets; then, in buckets that still hold several groups, all classes of different groups are compared,
   block by block, as products of shingle incidence matrices. Pairs become rows only if they link.
5. Links feed distributed connected components; one row of each component stays.

op5's radius of 4 bits and its pigeonhole blocks would not do here: a radius that reaches similarity 0.8 leaves blocks of 4 bits, and every
fingerprint would meet a constant share of all others.

Defined cases: null text is the empty text; texts without words are copies of each other; a text of fewer than five words is one
shingle; null ids come after every id and are separate documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import BYTE_VALUE, NO_ID, Rolling, chunks, cut, in_buckets, mix, tag_of, text_buffer, words_of
from basalt.llm.components import components, smallest_reachable
from basalt.llm.simhash_dedup import BKTree

SHINGLE = 5
#: Bits up to which fingerprints are candidates: over all 128, and over the first 64, which BK-trees hold. Sets of few shingles differ in more bits than large ones.
RADIUS, NEAR = 38, 22
#: Mean size of a shard, members of a tree, and the share of pairs of similarity 0.8 that may share no shard.
SHARD, TREE, MISS = 512, 1024, 1e-4
#: Tables that are dealt into shards at once.
TABLES = 12
#: Members of a bucket that are compared at once.
BLOCK = 512
_salts = mix(np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow string column."""
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        text, bounds = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words_of(text, bounds)
        words = Rolling(Rolling(BYTE_VALUE[text]).of(starts, ends))
        every = words.every(SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(every[a : b - SHINGLE + 1] if b - a >= SHINGLE else words.of(np.array([a]), np.array([b]))) if b > a else every[:0]


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The two words of a non-empty set's fingerprint."""
    n, ones = len(shingles), np.zeros(128, dtype=np.int64)
    for i in range(0, n, 255):  # counts of 255 rows fit a byte
        bits = np.unpackbits(mix(shingles[i : i + 255, None] + _salts).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def shard_masks(n: int) -> np.ndarray:
    """The bits by which each table deals n fingerprints, as two words a table."""
    bits = min(48, max(0, math.ceil(math.log2(max(1, n) / SHARD))))
    alike = (1 - math.acos(8 / 9) / math.pi) ** bits
    tables = math.ceil(math.log(MISS) / math.log(1 - alike)) if bits else 1
    rng = np.random.default_rng(42)
    order = np.concatenate([rng.permutation(128) for _ in range(-(-tables * bits // 128) or 1)])
    chosen = np.zeros((tables, 128), dtype=np.uint8)
    for t in range(tables):
        chosen[t, order[t * bits : (t + 1) * bits]] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)


def set_prints(texts: DataFrame) -> DataFrame:
    """(id, tag, text) -> (id, tag, k, f0, f1): key of the shingle set, and its fingerprint (null for the empty set)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = [], np.zeros((batch.num_rows, 2), np.uint64)
            none = np.zeros(batch.num_rows, dtype=bool)
            for i, s in enumerate(shingle_sets(batch.column(2))):
                keys.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                none[i] = not len(s)
                if len(s):
                    prints[i] = simhash(s)
            words = [pa.array(prints[:, j].view(np.int64) if batch.num_rows else [], pa.int64(), mask=none) for j in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), *words], names=["id", "tag", "k", "f0", "f1"])

    return texts.mapInArrow(run, "id long, tag long, k long, f0 long, f1 long")


def sharded(classes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(k, f0, f1) -> (shard, k, f0, f1), a row for each table."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f0, f1 = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            for t, (m0, m1) in enumerate(masks):
                shard = mix(mix((f0 & m0) + np.uint64(t)) + (f1 & m1))
                yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), *batch.columns], names=["shard", "k", "f0", "f1"])

    return classes.mapInArrow(run, "shard long, k long, f0 long, f1 long")


def near_prints(f0: np.ndarray, f1: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of fingerprints at most RADIUS bits apart, by a BK-tree of those on the right."""
    right = right[np.argsort(f0[right], kind="stable")]
    values, begin, many = np.unique(f0[right], return_index=True, return_counts=True)
    query, value = BKTree(values).within(f0[left], NEAR)
    at = np.searchsorted(values, value)
    step = np.arange(int(many[at].sum())) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
    i, j = left[np.repeat(query, many[at])], right[np.repeat(begin[at], many[at]) + step]
    near = np.bitwise_count(f0[i] ^ f0[j]).astype(np.int64) + np.bitwise_count(f1[i] ^ f1[j]) <= RADIUS
    near &= i != j
    return i[near], j[near]


def candidates(prints: DataFrame) -> DataFrame:
    """(key, k, center): buckets of fingerprints that hang together within RADIUS bits in a shard, each with its smallest class."""
    classes = cut(prints.where("f0 is not null").select("k", "f0", "f1").distinct(), "classes")
    masks = shard_masks(classes.count())
    parts = [in_shards(classes, some) for some in np.array_split(masks, -(-len(masks) // TABLES))]
    return cut(reduce(DataFrame.unionAll, parts).distinct(), "members") if len(parts) > 1 else parts[0]


def in_shards(classes: DataFrame, masks: np.ndarray) -> DataFrame:
    """The buckets (key, k, center) of a few tables.

    A shard of over TREE members is cut into blocks by hash; two blocks are one unit of work, dealt by its own key.
    """
    import pyarrow as pa

    rows = sharded(classes, masks)
    large = cut(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TREE).select("shard", F.ceil(F.col("size") / TREE).cast("int").alias("blocks")), "large")
    block = rows.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "k", "f0", "f1")

    def found(unit: list[np.ndarray]) -> np.ndarray:
        shard, a, b, block, k, f0, f1 = (np.concatenate(x) for x in zip(*unit, strict=True))
        none = np.zeros((0, 3), np.int64)
        if len(k) < 2:
            return none
        every = np.arange(len(k))
        i, j = near_prints(f0.view(np.uint64), f1.view(np.uint64), every[block == a[0]], every[block == b[0]])
        if not len(i):
            return none
        order = np.argsort(k, kind="stable")
        place = np.empty_like(order)
        place[order] = every
        root = smallest_reachable(len(k), place[i], place[j])
        k, many = k[order], np.bincount(root, minlength=len(k))
        key = np.zeros(len(k), np.uint64)
        np.add.at(key, root, mix(k.view(np.uint64)))  # the same members give the same key in every table
        held = many[root] > 1
        return np.stack([mix(key[root]).view(np.int64), k, k[root]], axis=1)[held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come grouped by unit."""
        last, unit = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(7)]
            head = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]))
            out = []
            for i, j in zip(head.tolist(), [*head[1:].tolist(), batch.num_rows], strict=True):
                key = tuple(int(c[i]) for c in columns[:3])
                if key != last and unit:
                    out.append(found(unit))
                    unit = []
                last = key
                unit.append([c[i:j].copy() for c in columns])
            yield rows_of(out)
        if unit:
            yield rows_of([found(unit)])

    def rows_of(out: list[np.ndarray]) -> pa.RecordBatch:
        made = np.concatenate([np.zeros((0, 3), np.int64), *out])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[:, i])) for i in range(3)], names=["key", "k", "center"])

    units = dealt.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b")
    return cut(units.mapInArrow(run, "key long, k long, center long").distinct(), "members")


def near_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, u_id, u_tag, v_id, v_tag) -> the pairs (u, v) of a Jaccard similarity of 0.8 or more.

    Texts stay in their buckets but those of u, which move to v: each v is in one pair, and of a u that many pairs share only numbers gather.
    """
    import pyarrow as pa

    def near(a: np.ndarray, b: np.ndarray) -> bool:
        if 5 * len(a) < 4 * len(b) or 5 * len(b) < 4 * len(a):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 5 * both >= 4 * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [near(a, b) for a, b in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(held, pa.bool_()))

    side = lambda c: texts.select(F.col("id").alias(f"{c}_id"), F.col("tag").alias(f"{c}_tag"), F.col("text").alias(f"of_{c}"))
    both = pairs.join(side("u"), ["u_id", "u_tag"]).join(side("v"), ["v_id", "v_tag"])
    return both.select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long")


def open_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, k) of the buckets that hold several groups, with each one's group."""
    found = components(links).select(F.col("vertex").alias("k"), "component")
    at = cut(members.join(found, "k", "left").select("key", "k", F.coalesce("component", "k").alias("own")), "groups")
    mixed = at.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most")
    return at.join(cut(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed"), "key")


def near_groups(own: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), i of left and j of right, of 0.8 or more between different groups; one for each two groups, as far as it joins."""
    sizes = np.array([len(x) for x in sets])
    found, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), times > 1
    place = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], place[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(at, (c, c + 4096))
        held = np.zeros((len(sets), min(4096, int(at[-1]) + 1 - c)), dtype=np.float32)
        held[owner[i:j], at[i:j] - c] = 1
        both += held[left] @ held[right].T
    both = both.astype(np.int64)
    x, y = np.nonzero((5 * both >= 4 * (sizes[left][:, None] + sizes[right][None] - both)) & (own[left][:, None] != own[right][None]))
    x, y = left[x], right[y]
    groups, code = np.unique(own, return_inverse=True)
    root, out = list(range(len(groups))), []

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    for n in np.unique(code[x] * len(groups) + code[y], return_index=True)[1].tolist():
        if (g := find(int(code[x[n]]))) != (h := find(int(code[y[n]]))):
            root[g] = h
            out.append((int(x[n]), int(y[n])))
    return out


def bucket_links(members: DataFrame, lead: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that join all groups which the similar pairs of a bucket join; members (key, k, own, blocks), lead (k, id, tag).

    A bucket is cut into blocks by hash; two blocks are one unit of work, dealt by its own key.
    """
    import pyarrow as pa

    block = members.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "k", "own")
    dealt = cut(dealt.join(lead, "k"), "dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, unit = None, []

        def links() -> list[tuple[int, int]]:
            if len(unit) < 2:
                return []
            blocks, every = np.array([m[0] for m in unit]), np.arange(len(unit))
            left, right = (every, every) if last[1] == last[2] else (every[blocks == last[1]], every[blocks == last[2]])
            if not len(left) or not len(right):
                return []
            return [(unit[i][1], unit[j][1]) for i, j in near_groups(np.array([m[2] for m in unit]), [m[3] for m in unit], left, right)]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            found = []
            for (key, a, b, block, k, own), held in zip(rows, shingle_sets(batch.column(6)), strict=True):
                if (key, a, b) != last:
                    found += links()
                    last, unit = (key, a, b), []
                unit.append((block, k, own, held))
            yield batch_of(found)
        yield batch_of(links())

    rows = dealt.join(texts, ["id", "tag"]).select("key", "a", "b", "block", "k", "own", "text")
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def set_links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (u, v) between set keys that join all that the verified pairs of any bucket join."""
    members = candidates(prints)
    lead = prints.join(cut(members.select("k").distinct(), "sharing"), "k", "left_semi").groupBy("k").agg(F.min(F.struct("id", "tag")).alias("at"))
    lead = cut(lead.select("k", "at.*"), "lead")

    tried = members.where("k <> center").groupBy("k").agg(F.min("center").alias("u")).select("u", F.col("k").alias("v"))
    side = lambda c: lead.select(F.col("k").alias(c), F.col("id").alias(f"{c}_id"), F.col("tag").alias(f"{c}_tag"))
    links = cut(near_pairs(cut(tried.join(side("v"), "v").join(side("u"), "u"), "pairs"), texts), "near")
    return links.unionAll(bucket_links(open_members(members, links), lead, texts))


def filed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, row), one row of each id and text in buckets: the least by its other columns. Tags tell null ids apart."""
    columns = [docs[c] for c in docs.columns]
    others = F.to_json(F.struct(docs[text_col].isNull().alias("none"), *[c.alias(f"c{i}") for i, c in enumerate(columns) if docs.columns[i] != text_col]))
    marked = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), tag_of(docs[text_col]).alias("tag"), others.alias("order"), F.struct(*columns).alias("row"))
    return in_buckets(marked.groupBy("id", "tag").agg(F.min_by("row", "order").alias("row")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each component, with all its columns: that of the smallest id, then text hash, then other columns."""
    rows = filed_rows(docs, id_col, text_col)
    texts = rows.select("id", "tag", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text"))
    prints = cut(set_prints(texts), "shingles")
    found = components(set_links(texts, prints)).select(F.col("vertex").alias("k"), "component")
    reach = prints.select("k", "id", "tag").join(cut(found, "found"), "k", "left").select(F.coalesce("component", "k").alias("component"), "id", "tag")
    kept = cut(reach.groupBy("component").agg(F.min(F.struct("id", "tag")).alias("at")).select("at.*"), "kept")
    return rows.join(kept, ["id", "tag"], "left_semi").select("row.*")
