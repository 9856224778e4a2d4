"""SimHash near-duplicates with sharded BK-trees.

1. Each text gets a 64-bit SimHash of its lower-cased word shingles (XXH64, seed 42, majority of the hashes' bits).
2. Equal fingerprints collapse into one class; from here on only distinct fingerprints move.
3. A fingerprint is cut into `m` blocks. Two fingerprints within `radius` bits agree on at least m - radius whole blocks,
   so every choice of m - radius blocks names shards in which all links are found. m grows with the number of fingerprints
   so that a shard's expected size stays bounded; every m finds every link.
4. A shard's fingerprints become BK-trees (children keyed by integer Hamming distance to the parent) of at most TREE members, built
   once and written. The members of a tree search it and the earlier ones of their shard, following only edges within
   the radius. Trees are broadcast to their queries while the written trees are at most BROADCAST bytes; a larger corpus joins
   both by shard instead, since a broadcast would grow with it. Both ways compare the same.
5. Links between fingerprints feed distributed connected components.

Defined cases: null text is the empty text; texts without words have fingerprint zero and link like any other; repeated rows
get the same component; null ids take part as the largest id (a component of null ids alone has a null component_id); an
empty table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import NO_ID, cut, keyed_texts, real_id, tag_of
from basalt.llm.components import components, smallest_reachable

#: Members of a tree, and bytes of trees (26 a member) up to which they are broadcast.
TREE, BROADCAST = 4096, 32 << 20
#: Mean shard size above which fingerprints are cut into more blocks.
SHARD = 1024


def fingerprint(text: str, shingle: int, xxh64=None) -> int:
    """SimHash of one text as an unsigned integer."""
    if xxh64 is None:
        from xxhash import xxh64_intdigest as xxh64
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct 64-bit integers under Hamming distance: a node's children are keyed by their distance to it.

    Nodes are numbered level by level, so that a node's children are neighbours: those of node i are begin[i] .. begin[i] + many[i] - 1,
    and edge[j] is the distance of node j to its parent.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.value, self.edge, self.begin, self.many = values.copy(), np.zeros(n, np.int16), np.zeros(n, np.int64), np.zeros(n, np.int64)
        made, rest, at = 1, values[1:], np.zeros(max(0, n - 1), np.int64)
        while len(rest):
            key = at * 65 + np.bitwise_count(rest ^ self.value[at])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])  # the first at each distance becomes a child, the others go on from it
            child = made + np.cumsum(head) - 1
            new = slice(made, made + int(head.sum()))
            self.value[new], self.edge[new] = rest[head], key[head] % 65
            parent, first, many = np.unique(key[head] // 65, return_index=True, return_counts=True)
            self.begin[parent], self.many[parent] = made + first, many
            made, rest, at = new.stop, rest[~head], child[~head]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, value) of all values at most radius bits from a query; only edges within the radius are followed."""
        numbers, values = [np.zeros(0, np.int64)], [self.value[:0]]
        for i in range(0, len(queries), 256):
            query, node = np.arange(i, min(i + 256, len(queries))), np.zeros(min(256, len(queries) - i), np.int64)
            while len(query):
                d = np.bitwise_count(queries[query] ^ self.value[node]).astype(np.int64)
                hit = d <= radius
                numbers.append(query[hit])
                values.append(self.value[node[hit]])
                many = self.many[node]
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                query, d, node = np.repeat(query, many), np.repeat(d, many), np.repeat(self.begin[node], many) + step
                near = np.abs(self.edge[node] - d) <= radius
                query, node = query[near], node[near]
        return np.concatenate(numbers), np.concatenate(values)

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.value, self.edge, self.begin, self.many))

    @classmethod
    def unpacked(cls, raw: bytes) -> BKTree:
        tree, n = cls.__new__(cls), len(raw) // 26
        tree.value, tree.edge = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int16, n, 8 * n)
        tree.begin, tree.many = np.frombuffer(raw, np.int64, n, 10 * n), np.frombuffer(raw, np.int64, n, 18 * n)
        return tree


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks for which a shard of n random fingerprints has about SHARD members or fewer."""
    m = radius + 1
    while m < radius + 4 and n / 2 ** (64 * (m - radius) / m) > SHARD:
        m += 1
    return m


def shard_masks(m: int, radius: int) -> list[int]:
    edges = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(m), m - radius)]


def with_fingerprints(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, tag, text) -> (id, tag, fp)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, xxh64_intdigest) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["id", "tag", "fp"])

    return texts.mapInArrow(run, "id long, tag long, fp long")


def shard_trees(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """Distinct (fp) -> (mask, part, number, tree): the trees of each shard, built once; a shard of over `most` members has several."""
    import pyarrow as pa

    masks = shard_masks(blocks_for(distinct.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    sharded = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "part"))
    sizes = sharded.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = cut(sharded, "sharded").join(cut(sizes, "sizes"), ["mask", "part"])
    keys = ["mask", "part", "number"]
    dealt = sized.withColumn("number", F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / most)).cast("int")).select(*keys, "fp")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come grouped by keys."""
        last, held = None, []

        def out(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(*key, BKTree(np.concatenate(parts)).packed()) for key, parts in made], strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=[*keys, "tree"])

        for batch in batches:
            mask, part, number, fp = (batch.column(i).to_numpy() for i in range(4))
            head = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1]) | (number[1:] != number[:-1])]))
            made = []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(fp)], strict=True):
                key = (int(mask[a]), int(part[a]), int(number[a]))
                if key != last and held:
                    made.append((last, held))
                    held = []
                last = key
                held.append(fp[a:b].view(np.uint64))
            yield out(made)
        if held:
            yield out([(last, held)])

    return cut(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(build, "mask int, part long, number int, tree binary"), "trees")


def fingerprint_links(distinct: DataFrame, radius: int, most: int = TREE) -> DataFrame:
    """Distinct (fp) -> links (u, v) between fingerprints at most `radius` bits apart that join all that such links join."""
    import pyarrow as pa

    trees = shard_trees(distinct, radius, most)
    # the members of a tree search it and the earlier trees of their shard
    queries = trees.select("mask", "part", F.col("number").alias("own"), F.expr("substring(tree, 1, int(length(tree) * 8 / 26))").alias("members"))
    size = trees.agg(F.coalesce(F.sum(F.length("tree")), F.lit(0))).first()[0]
    sent = F.broadcast(trees) if size <= BROADCAST else trees.hint("merge")
    units = queries.join(sent, ["mask", "part"]).where("number <= own").select(F.expr("number = own").alias("same"), "members", "tree")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for same, members, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(members, np.uint64)
                query, value = BKTree.unpacked(raw).within(own, radius)
                if same:
                    query, value = query[value < own[query]], value[value < own[query]]
                if len(query):  # each member with the smallest that it reaches here: a dense group gives no more rows than members
                    every, at = np.unique(np.concatenate([own[query], value]), return_inverse=True)
                    root = smallest_reachable(len(every), at[: len(query)], at[len(query) :])
                    found.append(np.stack([every, every[root]], axis=1).view(np.int64)[root != np.arange(len(every))])
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return units.mapInArrow(search, "u long, v long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4
) -> DataFrame:
    """One row per document: (id_col, fingerprint as 16 hex digits, component_id, tag); component_id is the smallest id reachable."""
    prints = cut(with_fingerprints(keyed_texts(docs, id_col, text_col), shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    grouped = components(fingerprint_links(classes.select("fp"), radius))
    reach = classes.join(grouped.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    reach = cut(reach, "reach")
    # written tables on both sides of a join let Spark split a component that very many fingerprints share
    smallest = cut(reach.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    found = reach.join(smallest, "component").select("fp", "component_id")
    return prints.join(found, "fp").select(
        real_id().alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("component_id").alias("component_id"), "tag"
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep one document of each component, with all its columns: that of the smallest id.

    Rows that repeat this id are told apart by text, then by all other columns; one of them stays.
    """
    found = simhash_components(docs, id_col, text_col, **options)
    kept = found.where(found[id_col].eqNullSafe(found["component_id"])).select(F.coalesce(id_col, F.lit(NO_ID)).alias("__id"), "tag").distinct()
    kept = kept.groupBy("__id").agg(F.min("tag").alias("__tag"))
    marked = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("__id"),
        tag_of(docs[text_col]).alias("__tag"),
    )
    # an aggregate, not a window: rows that repeat an id are reduced before the shuffle
    once = marked.join(kept, ["__id", "__tag"], "left_semi").groupBy("__id", "__tag").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs, shingle=4).drop("tag")
