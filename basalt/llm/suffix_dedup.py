"""Suffix-array dedup of byte ranges with run-length Burrows-Wheeler indexes.

Every byte covered by a string of `length` bytes that also starts earlier (smaller id, or same document and earlier place) is
removed. Which strings do is read from indexes alone. Winnowed seeds (repeats.py) route all places where equal strings can
start to one index, so that indexes stay small while together they cover the corpus:

1. Every seed that occurs twice brings its segments. Equal segments are one class, which carries its earliest place; copies
   of a class cost a narrow row each.
2. The classes of a seed lie in one collection. A collection gets a run-compressed Burrows-Wheeler transform; suffix samples
   are kept at run ends alone, and only there are match lengths computed. In text order a match loses exactly one byte a step
   until the next run head, so matching statistics stream from those samples; in repetitive collections runs are few.
3. Neighbouring suffixes whose match reaches `length` form a group; the earliest place of its members goes back to each of
   them, and from a class to its copies. A place later than the earliest one is removed.
4. A seed of more than MOST classes would make one collection grow with the corpus. It is deepened: each of its segments is split in
   two, windows that reach far right of the seed and the others, each with a longer seed that all of its windows hold. Longer seeds
   have fewer classes; one of `length` bytes has a single class.

Defined cases: null text is empty; texts under `length` bytes lose nothing; matches never cross documents; rows that repeat id
and text are equal places, neither earlier, so both lose the same; null ids sort last; an empty table gives an empty
result; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import BYTE_VALUE, Rolling, cut, filed, keyed_texts, mix, real_id, text_buffer
from basalt.llm.repeats import list_column, seeds, signed, without_spans

LENGTH, SEED = 100, 32
#: Bytes after which a collection is closed. A seed is never split, so one index covers this and one seed's classes at most.
COLLECTION = 1 << 16
#: Classes of a seed beyond which it is deepened: about 1 MB of segments.
MOST = 6000
#: Spans of which a task hashes the bytes at a time when seeds are deepened; their arrays fit a processor's cache.
SPANS = 500
#: Symbols of 9 bits that a 64-bit word holds beside the number of a string.
PACKED = 6
_PLACE = 40  # bits of a place in `when`


class RunLengthIndex:
    """Run-length BWT of a collection of byte strings, each with its own terminator, in the order given.

    data, bounds: string i is data[bounds[i]:bounds[i + 1]]; in the text it is followed by terminator i, which is smaller than
    every byte and than later terminators. Places and ranks take 32 bits, since ranks of six lengths are held at once.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        m = len(bounds) - 1
        sizes = np.diff(bounds)
        self.starts = bounds[:-1] + np.arange(m)
        self.ends = self.starts + sizes
        n = len(data) + m
        if n >= 1 << 31:
            raise ValueError("a collection has under 2 GB")
        text = np.zeros(n, dtype=np.uint16)
        inside = np.ones(n, dtype=bool)
        inside[self.ends] = False
        text[inside] = data.astype(np.uint16) + np.uint16(1)
        string = np.repeat(np.arange(m, dtype=np.int32), sizes + 1)
        self.left = np.repeat(self.ends.astype(np.int32), sizes + 1) - np.arange(n, dtype=np.int32)
        self.order, self.ranks = self._sort(text, string)
        self.text = text
        # the symbol before each suffix; string starts have their own terminator before them, equal to no other
        before = np.where(self.order > 0, text[self.order - 1], np.uint16(0))
        first = np.zeros(n, dtype=bool)
        first[self.starts] = True
        own = first[self.order] | ~inside[self.order]
        self.heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | own[1:] | own[:-1]]))
        self.run_symbols = before[self.heads]
        self.head_samples = self.order[self.heads]
        self.end_samples = self.order[np.append(self.heads[1:], n) - 1]
        self.n = n

    def _sort(self, text: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix order by prefix doubling from packed prefixes, and each place's rank by its first 6, 12, 24, .. symbols."""
        n, h = len(text), PACKED
        packed = np.zeros(n, dtype=np.uint64)
        for i in range(h):
            shifted = np.zeros(n, dtype=np.uint16)
            shifted[: n - i] = text[i:]
            shifted[self.left < i] = 0
            packed <<= np.uint64(9)
            packed |= shifted
        packed <<= np.uint64(10)
        short = self.left < h  # such a prefix holds its terminator, so that the low bits are free for that one's number
        packed[short] |= string[short].astype(np.uint64) + np.uint64(1)
        order = np.argsort(packed).astype(np.int32)
        packed = packed[order]
        fresh = np.concatenate([[True], packed[1:] != packed[:-1]])
        del packed, shifted, short
        rank, ranks = np.empty(n, dtype=np.int32), []
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
        while True:
            ranks.append(rank)
            tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True)).astype(np.int32)
            if not len(tied):
                return order, ranks
            at = order[tied]
            key = rank[at].astype(np.int64)
            key *= n
            key += rank[at + h]  # tied places hold no terminator in their first h symbols
            by = np.argsort(key)
            order[tied], key = at[by], key[by]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[order[tied]] = np.maximum.accumulate(np.where(head, tied, np.int32(0)))
            fresh[tied] = head
            h *= 2

    def matching_statistics(self) -> np.ndarray:
        """For each text place, the length of its match with the suffix just before it in suffix order."""
        a, b = self.head_samples[1:], self.end_samples[:-1]
        match = np.zeros(len(a), dtype=np.int32)
        for k in range(len(self.ranks) - 2, -1, -1):
            match += (self.ranks[k][a + match] == self.ranks[k][b + match]) * np.int32(PACKED << k)
        for _ in range(PACKED - 1):
            here = self.text[a + match]
            match += (here == self.text[b + match]) & (here > 0)
        known, at = np.zeros(self.n, dtype=np.int32), np.zeros(self.n, dtype=np.int32)
        known[a] = match
        at[a] = a
        at[self.head_samples[0]] = self.head_samples[0]
        at = np.maximum.accumulate(at)
        return np.maximum(known[at] - (np.arange(self.n, dtype=np.int32) - at), 0)

    def earliest(self, length: int, when: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, place in it, earliest `when` of the string of `length` bytes there) for every such place.

        when: for each string, the order of its first byte among all places; the following bytes count on from it.
        """
        long = self.matching_statistics()[self.order] >= length
        long[0] = False
        heads = np.flatnonzero(~long)
        sizes = self.ends - self.starts + 1
        string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(self.n, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), sizes)
        order_of = np.repeat(when, sizes)
        order_of += place
        earliest = np.minimum.reduceat(order_of[self.order], heads)
        least = order_of
        least[self.order] = np.repeat(earliest, np.diff(np.append(heads, self.n)))
        whole = np.flatnonzero(self.left >= length)
        return string[whole], place[whole].astype(np.int64), least[whole]


def packed(first, windows, inset, size):
    """One number for a segment: its first byte, its windows, how far its seed lies behind the first byte, the seed's size; ordered by the first.

    Columns or arrays; lengths are below 4096.
    """
    return ((first * 4096 + windows) * 4096 + inset) * 4096 + size


def unpacked(segment):
    """(first, windows, inset, size) of packed columns or arrays."""
    shift = (lambda x, n: F.shiftright(x, n)) if isinstance(segment, Column) else (lambda x, n: x >> n)
    low = (lambda x: x.bitwiseAND(F.lit(4095).cast("long"))) if isinstance(segment, Column) else (lambda x: x & 4095)
    return shift(segment, 36), low(shift(segment, 24)), low(shift(segment, 12)), low(segment)


def span_columns(batch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each span, the spans' fields) of the list column of a batch."""
    at, fields = list_column(batch, 3)
    return np.repeat(np.arange(batch.num_rows), np.diff(at)), fields


def segment_texts(found: DataFrame, length: int) -> DataFrame:
    """(id, tag, text, spans of key, segment, at) -> (key, segment, id, first, bytes), a row for each span."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            raw = memoryview(data)
            doc, (key, segment, at) = span_columns(batch)
            for i in range(0, len(doc), 20_000):
                s = slice(i, i + 20_000)
                first, windows, _, _ = unpacked(at[s])
                start = offsets[doc[s]] + first
                parts = pa.array([raw[a:b].tobytes() for a, b in zip(start.tolist(), (start + windows + (length - 1)).tolist(), strict=True)], pa.binary())
                own = batch.column(0).take(pa.array(doc[s]))
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(segment[s]), own, pa.array(first), parts], names=["key", "segment", "id", "first", "bytes"])

    return found.mapInArrow(run, "key long, segment long, id long, first long, bytes binary")


def deepened(found: DataFrame, length: int) -> DataFrame:
    """(id, tag, text, spans of key, at) -> the spans' two halves under longer seeds."""
    import pyarrow as pa

    names = ["key", "segment", "id", "tag", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc, (key, at) = span_columns(batch)
            for i in range(0, len(doc), SPANS):
                own = doc[i : i + SPANS]
                yield from halves(data, offsets[own], key[i : i + SPANS], at[i : i + SPANS], ids[own], tags[own])

    def halves(data, base, key, at, ids, tags) -> Iterator[pa.RecordBatch]:
        """base: where in data each span's text begins. The spans' bytes alone are hashed, since a batch holds thousands of whole texts."""
        first, windows, inset, size = unpacked(at)
        n = windows + (length - 1)
        bounds = np.concatenate([[0], np.cumsum(n)])
        rolling = Rolling(BYTE_VALUE[data[np.arange(bounds[-1]) + np.repeat(base + first - bounds[:-1], n)]])
        base = bounds[:-1] - first
        place = first + inset
        stop, spare = first + windows, length - size
        reach = (spare + 1) // 2  # windows from `turn` on hold that many bytes behind the seed, the others more than the rest before it
        turn = np.clip(place + size + reach - length, first, stop)
        for begin, end, seed_at, seed_size in ((turn, stop, place, size + reach), (first, turn, place - (spare - reach + 1), size + spare - reach + 1)):
            some = np.flatnonzero(end > begin)
            at, seed, n = base[some], seed_at[some], seed_size[some]
            left = key[some].view(np.uint64) ^ mix(n.astype(np.uint64))
            made = mix(left ^ rolling.of(at + seed, at + seed + n))
            whole = mix(rolling.of(at + begin[some], at + end[some] + (length - 1)) ^ mix((seed - begin[some]).astype(np.uint64)))
            columns = [made, whole, ids[some], tags[some], packed(begin[some], (end - begin)[some], seed - begin[some], n)]
            yield pa.RecordBatch.from_arrays([signed(c) for c in columns], names=names)

    return found.mapInArrow(run, "key long, segment long, id long, tag long, at long")


def with_texts(texts: DataFrame, spans: DataFrame, *fields: str) -> DataFrame:
    """(id, tag, text, spans): each document's spans. Where texts are filed, the spans alone move."""
    per_text = spans.groupBy("id", "tag").agg(F.collect_set(F.struct(*fields)).alias("spans"))
    return texts.join(per_text, ["id", "tag"]).select("id", "tag", "text", "spans")


def routed(texts: DataFrame, length: int, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Places (key, segment, id, tag, at) of all segments whose seed occurs twice, and their classes with the earliest place."""
    found = seeds(texts, "byte", length, seed)
    found = found.select("key", "segment", "id", "tag", packed(F.col("first"), F.col("windows"), F.col("place") - F.col("first"), F.lit(seed)).alias("at"))
    keys = seeds(texts, "byte", length, seed, keys_only=True)
    places = classes = None
    while True:
        shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
        # written tables on both sides of a merge join let Spark split a seed that very many documents share
        mine = cut(found.join(shared.hint("merge"), "key", "left_semi"), "segments")
        kinds = cut(mine.groupBy("key", "segment").agg(F.min(F.struct("id", "at", "tag")).alias("lead")).select("key", "segment", "lead.*"), "classes")
        crowded = cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "crowded")
        if crowded.isEmpty():
            here, own = mine, kinds
        else:
            here, own = mine.join(crowded, "key", "left_anti"), kinds.join(crowded, "key", "left_anti")
        places, classes = (here, own) if places is None else (places.unionByName(here), classes.unionByName(own))
        if crowded.isEmpty():
            return places, classes
        keys = found = deepened(with_texts(texts, mine.join(crowded, "key", "left_semi"), "key", "at"), length)


def indexed(parts: DataFrame, length: int) -> DataFrame:
    """(key, segment, id, first, bytes) -> (key, segment, offset, n, early_id, early): windows of a class that start earliest elsewhere or here.

    Window `offset` and the n - 1 after it start earliest in document early_id, from place `early` on.
    """
    import pyarrow as pa

    names = ["key", "segment", "offset", "n", "early_id", "early"]

    def search(table: pa.Table) -> pa.RecordBatch:
        key, segment, ids, firsts = (table.column(i).to_numpy() for i in range(4))
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])])  # rows that repeat bring a class again
        if not once.all():
            table, key, segment, ids, firsts = table.filter(pa.array(once)), key[once], segment[once], ids[once], firsts[once]
        data, offsets = text_buffer(table.column(4))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        known, rank = np.unique(ids, return_inverse=True)
        string, place, least = RunLengthIndex(data, offsets).earliest(length, (rank.astype(np.int64) << _PLACE) + firsts)
        head = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (least[1:] != least[:-1] + 1)]))
        n = np.diff(np.append(head, len(string)))
        s, early = string[head], least[head]
        columns = [key[s], segment[s], place[head], n, known[early >> _PLACE], early & ((1 << _PLACE) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key; whole keys are gathered until a collection is full."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            _, offsets = text_buffer(batch.column(4))
            begun = 0
            for end in ends.tolist():
                if size >= COLLECTION and held[-1].column(0)[-1].as_py() != int(keys[begun]):
                    yield search(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(begun, end - begun))
                size += int(offsets[end] - offsets[begun])
                begun = end
        if held:
            yield search(pa.Table.from_batches(held))

    ordered = parts.repartition("key").sortWithinPartitions("key", "segment")
    return ordered.mapInArrow(run, "key long, segment long, offset long, n long, early_id long, early long")


def repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(id, tag, first, until): ranges of bytes that start earlier, found by the indexes."""
    places, classes = routed(texts, length, seed, most)
    parts = segment_texts(with_texts(texts, classes, "key", "segment", "at"), length)
    earliest = cut(indexed(parts, length), "indexed")
    first = unpacked(F.col("at"))[0] + F.col("offset")
    late = F.struct("early_id", "early") < F.struct(F.col("id").alias("early_id"), first.alias("early"))
    return places.join(earliest.hint("merge"), ["key", "segment"]).where(late).select("id", "tag", first.alias("first"), (first + F.col("n") + (length - 1)).alias("until"))


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = True, most: int = MOST
) -> DataFrame:
    """(id, tag, n_symbols, n_removed, n_spans, kept_sha256[, kept_text]), one row per document; symbols are bytes."""
    texts = filed(keyed_texts(docs, id_col, text_col))
    spans = repeats(texts, length, seed, most).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "until")).alias("spans"))
    return without_spans(texts, cut(spans, "spans"), "byte", with_text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, with_text=False).select(
        real_id().alias("doc_id"), F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"
    )
