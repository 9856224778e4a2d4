"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A document is its token ids and a closing id 0. Only documents longer than a sequence are cut: into full pieces behind a
first piece that takes the rest, so at most one piece of a document is not full. Full pieces are sequences of their own. The
others are dealt at random to shards of bounded size. Each shard is packed by a grouping genetic algorithm (Falkenauer, 1996) on
several islands that evolve apart, each from its own random groupings: a crossover injects whole well-filled bins of one parent
into the other, removes bins that now hold a document twice, and best-fits the displaced documents. Between epochs
each island's elite - its best groupings - migrates to the next island of the shard and breeds there. The best grouping of
all islands wins; its well-filled bins are final, and the documents of its other bins are dealt to new shards with those
of other shards, where they are packed again. The last deal accepts all bins.

Defined cases: null text is empty, and an empty document is the single id 0; repeated rows are packed each on its own; ties in
length do not matter; null ids are packed like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut

LENGTH, END = 2048, 0
#: Mean pieces of a shard, its islands, groupings kept on an island, generations of an epoch, epochs, and elites that migrate.
SHARD, ISLANDS, POPULATION, GENERATIONS, EPOCHS, ELITES = 2000, 3, 4, 12, 2, 2
#: Times that pieces are dealt to shards, and the share of a sequence that a bin has to fill to be final before the last of them.
DEALS, FULL = 3, 0.998


class Tokens:
    """Token ids as `tokenizers` gives them for a tokenizer file with add_special_tokens=False.

    A byte-level BPE whose ids follow its merges is the same function in `tiktoken`, which encodes several times faster. Texts that
    hold an added token's string, any other file, and a text that library gives up on go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._by_ranks(path)

    @staticmethod
    def _by_ranks(path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            return None
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(set(made)):
            return None
        # byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
        return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except Exception:
                pass
            except BaseException as failed:  # a panic of the native regex is no Exception
                if type(failed).__name__ != "PanicException":
                    raise
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, with_ids: bool) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]), a row for each piece."""
    import pyarrow as pa

    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = Tokens(tokenizer)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*tokens.ids(text.as_py() or ""), END], dtype="<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(i)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *[ids[a:b].astype(np.int32)] * with_ids))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array([r[c] for r in out], kinds[c]) for c in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)

    own = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(bins: list[list[int]], loads: list[int], items, sizes: list[int], length: int) -> None:
    """Put items, largest first, each into the fullest bin that holds it; new bins where none does."""
    free = sorted((length - load, b) for b, load in enumerate(loads))
    for x in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[x], -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(x)
            loads[b] += sizes[x]
        else:
            room, b = length, len(bins)
            bins.append([x])
            loads.append(sizes[x])
        if room > sizes[x]:
            insort(free, (room - sizes[x], b))


def crossover(into: tuple, other: tuple, sizes: list[int], length: int, rng: np.random.Generator) -> tuple:
    """Inject a random share of the other's well-filled bins, drop bins that hold a document twice, best-fit the displaced."""
    loads = np.array(other[1])
    order = np.argsort(-loads + rng.random(len(loads)) * length * 0.02)
    chosen = order[: max(1, int(len(order) * rng.uniform(0.2, 0.6)))].tolist()
    taken = {x for b in chosen for x in other[0][b]}
    bins, new_loads, displaced = [list(other[0][b]) for b in chosen], [other[1][b] for b in chosen], []
    for items, load in zip(*into, strict=True):
        if taken.isdisjoint(items):
            bins.append(list(items))
            new_loads.append(load)
        else:
            displaced += [x for x in items if x not in taken]
    best_fit(bins, new_loads, displaced, sizes, length)
    return bins, new_loads


def fitness(grouping: tuple, length: int) -> tuple[int, float]:
    """Fewer bins, then more uneven fill (the mean square of fill), is better."""
    return -len(grouping[0]), sum((x / length) ** 2 for x in grouping[1]) / max(1, len(grouping[1]))


def random_grouping(sizes: list[int], length: int, rng: np.random.Generator) -> tuple:
    """A quarter of the items in random order, so that groupings differ; the rest by best-fit decreasing."""
    bins: list[list[int]] = []
    loads: list[int] = []
    order = rng.permutation(len(sizes))
    for x in order[: len(order) // 4].tolist():
        fits = [b for b in range(len(bins) - 1, max(-1, len(bins) - 9), -1) if loads[b] + sizes[x] <= length]
        if fits:
            b = max(fits, key=loads.__getitem__)
            bins[b].append(x)
            loads[b] += sizes[x]
        else:
            bins.append([x])
            loads.append(sizes[x])
    best_fit(bins, loads, order[len(order) // 4 :].tolist(), sizes, length)
    return bins, loads


def evolve(
    sizes: list[int], length: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS, start: list[tuple] | None = None
) -> list[tuple]:
    """Groupings (bins of item numbers, their loads), best first, after some generations from `start` or from random ones.

    Ends early where a grouping has as few bins as the sizes' sum allows.
    """
    rng = np.random.default_rng(seed)
    kept = list(start or [])
    if not kept:
        bins: list[list[int]] = []
        loads: list[int] = []
        best_fit(bins, loads, range(len(sizes)), sizes, length)
        kept = [(bins, loads)]
    least = -(-sum(sizes) // length)
    while len(kept) < population and len(kept[0][0]) > least:
        kept.append(random_grouping(sizes, length, rng))
    better = lambda g: fitness(g, length)
    kept.sort(key=better, reverse=True)
    for _ in range(generations):
        if len(kept[0][0]) <= least:
            break
        a, b = rng.choice(len(kept), 2, replace=False)
        child = crossover(kept[a], kept[b], sizes, length, rng)
        if better(child) > better(kept[-1]):
            kept[-1] = child
            kept.sort(key=better, reverse=True)
    return kept[: max(population, 1)]


def encoded(grouping: tuple, n: int) -> bytes:
    """The bin of each item, as 32-bit numbers."""
    of = np.empty(n, dtype=np.int32)
    for b, items in enumerate(grouping[0]):
        of[items] = b
    return of.tobytes()


def decoded(raw: bytes, sizes: list[int]) -> tuple:
    of = np.frombuffer(raw, dtype=np.int32).tolist()
    bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
    for x, b in enumerate(of):
        bins[b].append(x)
    return bins, [sum(sizes[x] for x in items) for items in bins]


def epoch(islands: DataFrame, length: int, number: int, generations: int) -> DataFrame:
    """(shard, island, sizes, population) -> the same with evolved populations, best first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for shard, island, sizes, population in zip(rows["shard"], rows["island"], rows["sizes"], rows["population"], strict=True):
                sizes = [int(x) for x in sizes]
                start = [decoded(raw, sizes) for raw in population]
                out.append([encoded(g, len(sizes)) for g in evolve(sizes, length, (int(shard) * 64 + int(island)) * 64 + number, generations=generations, start=start)])
            yield rows.assign(population=out)

    return islands.mapInPandas(run, "shard long, island int, sizes array<long>, population array<binary>")


def best_groupings(items: DataFrame, length: int, generations: int) -> DataFrame:
    """(shard, item, length) -> (shard, items, sizes, grouping): the best of all islands after epochs with elite migration."""
    shards = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("rows"))
    shards = cut(shards.select("shard", F.col("rows.item").alias("items"), F.col("rows.length").alias("sizes")), "shards")
    no_grouping = F.array().cast("array<binary>")
    islands = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", no_grouping.alias("population"))
    for number in range(EPOCHS if generations else 1):
        if number:
            elites = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, ELITES).alias("elites"))
            islands = islands.join(elites, ["shard", "island"]).select("shard", "island", "sizes", F.array_distinct(F.concat("elites", "population")).alias("population"))
        islands = cut(epoch(islands, length, number, generations), "islands")
    n_bins = F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda i: F.substring(F.col("population")[0], i * 4 + 1, F.lit(4)))))
    best = islands.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct(n_bins.alias("n"), "island")).alias("grouping"))
    return shards.join(best, "shard")


def grouped(items: DataFrame, length: int, final: bool, deal: int, generations: int) -> DataFrame:
    """(shard, item, length) -> (item, length, bin, offset); bin -1 for what is dealt again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for shard, item, sizes, raw in zip(rows["shard"], rows["items"], rows["sizes"], rows["grouping"], strict=True):
                where, offset = np.full(len(item), -1), np.zeros(len(item), dtype=np.int64)
                for b, (members, load) in enumerate(zip(*decoded(raw, list(sizes)), strict=True)):
                    if final or load >= FULL * length:
                        where[members] = (np.int64(shard) << 32) | (np.int64(deal) << 24) | b
                        offset[members] = np.cumsum(sizes[members]) - sizes[members]
                yield pd.DataFrame({"item": item, "length": sizes, "bin": where, "offset": offset})

    return best_groupings(items, length, generations).mapInPandas(run, "item long, length long, bin long, offset long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True,
    generations: int = GENERATIONS,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row for each piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    # a written row number names a piece, whatever the ids are
    all_pieces = cut(pieces(docs, id_col, text_col, tokenizer, length, with_ids).withColumn("__item", F.monotonically_increasing_id()), "pieces")
    left = all_pieces.where(F.col("length") < length).select(F.col("__item").alias("item"), "length")
    done = all_pieces.where(F.col("length") >= length).select(F.col("__item").alias("item"), (-1 - F.col("__item")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    for deal in range(DEALS):
        shards = max(1, round(left.count() / SHARD))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(deal)), F.lit(shards)).cast("long"))
        found = cut(grouped(dealt, length, deal == DEALS - 1 or shards == 1, deal, generations), "deal")
        done = done.unionAll(found.where("bin >= 0").select("item", "bin", "offset"))
        left = found.where("bin < 0").select("item", "length")
        if shards == 1:
            break
    # deals and shards have their own ranges of numbers; full pieces take negative ones
    placed = done.select(F.col("item").alias("__item"), F.col("bin").alias("sequence_id"), "offset")
    return all_pieces.join(placed, "__item").drop("__item").select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
