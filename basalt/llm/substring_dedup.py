"""Substring dedup by seed and extend, over words.

1. Anchors: each document's winnowed seeds (see repeats.py), with the windows of `length` words that chose them.
2. Join: every anchor meets the earliest occurrence of the same anchor - its origin - and no other one, so that an anchor which
   very many documents share costs one row for each of them.
3. Extend: anchors of one document and origin on one diagonal form chains. The origin's words along a chain come to the
   document, and both are compared word by word, on bytes, to the left and right of each anchor until they differ or no window
   that chose the anchor reaches further. Matches of `length` words or more are maximal repeats; if the origin's
   id is smaller they are removed.
4. Windows that do not lie in the match hold the word where it broke off. They may still equal a window of another document
   that broke off there with the same word: anchor, direction, extent and that word are the key of a longer anchor, with which
   steps 2 and 3 are repeated. Keys grow by a word at least, so there are at most 2 * (length - seed) rounds; text that is
   not repeated leaves after the first.

Hashes choose what is compared; nothing is removed that has not been compared word by word. Two unlike anchors with equal
62-bit hashes could only hide a repeat.

Defined cases: null and blank texts have no words and lose none; texts of fewer than `length` words lose none; rows of one
id never remove words from each other, so repeated rows have equal results; a null id counts as larger than every other;
an empty table gives an empty result; other columns are not read and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import NO_ID, cut, filed, keyed_texts, real_id, tag_of
from basalt.llm.repeats import seeds, without_spans

#: Words of a window, of a seed, and of a block in which an origin's words travel.
LENGTH, SEED, BLOCK = 50, 25, 256
_PAIR = ["id", "tag", "origin", "origin_tag", "shift"]


def met_anchors(anchors: DataFrame) -> DataFrame:
    """(key, id, tag, place, first, windows) -> the anchors of each document and origin on a diagonal, a row per diagonal.

    shift: how much further to the right the anchors lie in the origin.
    """
    own = F.struct("id", "tag", "place")
    groups = anchors.groupBy("key").agg(F.min(own).alias("least"), F.max("id").alias("last")).where("least.id < last")
    # written tables on both sides of the join let Spark split an anchor that very many documents share
    shared = cut(groups.select("key", "least"), "shared")
    mine = cut(anchors.join(shared, "key").where(own > F.col("least")), "met")
    at = mine.select("id", "tag", F.col("least.id").alias("origin"), F.col("least.tag").alias("origin_tag"), (F.col("least.place") - F.col("place")).alias("shift"), "first", "windows", "place", "key")
    return cut(at.groupBy(*_PAIR).agg(F.sort_array(F.collect_set(F.struct("first", "windows", "place", "key"))).alias("anchors")), "diagonals")


def wanted_ranges(diagonals: DataFrame, length: int, block: int) -> DataFrame:
    """The chains of each diagonal, cut where a block of the origin ends: (.., number of the block, first word in it, words)."""
    import pyarrow as pa

    names = [*_PAIR, "block", "begin", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(5).offsets.to_numpy()
            first, windows = (batch.column(5).values.field(i).to_numpy() for i in (0, 1))
            shift, out = batch.column(4).to_numpy(), []
            for row in range(batch.num_rows):
                lo = first[at[row] : at[row + 1]]
                hi = np.maximum.accumulate(lo + windows[at[row] : at[row + 1]] + (length - 1))
                head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                for a, b in zip(lo[head].tolist(), hi[np.append(head[1:], len(lo)) - 1].tolist(), strict=True):
                    a, b = max(0, a + int(shift[row])), b + int(shift[row])
                    while a < b:
                        end = min(b, a - a % block + block)
                        out.append((row, a // block, a % block, end - a))
                        a = end
            made = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(made[:, 0])) for i in range(5)], *[pa.array(made[:, i]) for i in (1, 2, 3)]], names=names)

    return diagonals.mapInArrow(run, "id long, tag long, origin long, origin_tag long, shift long, block long, begin long, n long")


def blocks_of(texts: DataFrame, wanted: DataFrame, block: int) -> DataFrame:
    """(origin, origin_tag, block, words): the wanted blocks of the origins' texts, words joined by one space."""
    import pyarrow as pa

    names = ["origin", "origin_tag", "block", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, held = [], [], []
            for i in range(batch.num_rows):
                words = batch.column(2)[i].as_py().encode().split()
                for b in batch.column(3)[i].as_py():
                    if b * block < len(words):
                        rows.append(i)
                        numbers.append(b)
                        held.append(b" ".join(words[b * block : (b + 1) * block]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int64()), pa.array(held, pa.binary()).cast(pa.string())], names=names)

    numbers = wanted.groupBy(F.col("origin").alias("id"), F.col("origin_tag").alias("tag")).agg(F.collect_set("block").alias("numbers"))
    # texts are filed: the numbers alone move
    return texts.join(numbers, ["id", "tag"]).select("id", "tag", "text", "numbers").mapInArrow(run, "origin long, origin_tag long, block long, words string")


def equal_runs(words: list[bytes], pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a document's words that equal the origin's; pieces: (place in the document, the origin's words)."""
    starts: list[int] = []
    ends: list[int] = []
    for at, piece in sorted(pieces):
        other = piece.split()
        same = np.fromiter(map(eq, words[at : at + len(other)], other), bool, min(len(other), len(words) - at))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip((edge[::2] + at).tolist(), (edge[1::2] + at).tolist(), strict=True):
            if ends and ends[-1] == a:
                ends[-1] = b
            else:
                starts.append(a)
                ends.append(b)
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


def longer_key(key: int, right: bool, extent: int, word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b"%d %d %d " % (key, right, extent) + word) - (1 << 63)


def extended(texts: DataFrame, diagonals: DataFrame, length: int, block: int) -> DataFrame:
    """Repeats (id, tag, first, until) and longer anchors (key, id, tag, place, first, windows, until null)."""
    import pyarrow as pa

    wanted = wanted_ranges(diagonals, length, block)
    blocks = cut(blocks_of(texts, wanted, block), "blocks")
    words = F.array_join(F.slice(F.split("words", " "), (F.col("begin") + 1).cast("int"), F.col("n").cast("int")), " ")
    place = F.col("block") * block + F.col("begin") - F.col("shift")
    pieces = cut(wanted, "wanted").join(blocks, ["origin", "origin_tag", "block"]).select("id", "tag", "origin", "origin_tag", "shift", place.alias("at"), words.alias("words"))
    pieces = pieces.groupBy("id", "tag").agg(F.collect_set(F.struct("origin", "origin_tag", "shift", "at", "words")).alias("pieces"))
    mine = diagonals.groupBy("id", "tag").agg(F.collect_set(F.struct("origin", "origin_tag", "shift", "anchors")).alias("diagonals"))
    both = texts.join(mine, ["id", "tag"]).join(pieces, ["id", "tag"], "left").select("id", "tag", "text", "diagonals", "pieces")
    kinds = {"key": pa.int64(), "id": pa.int64(), "tag": pa.int64(), "place": pa.int64(), "first": pa.int64(), "windows": pa.int32(), "until": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            texts = batch.column(2).to_pylist()
            pieces = piece_groups(batch.column(4))
            groups, group_at = batch.column(3).values, batch.column(3).offsets.to_numpy()
            origin, origin_tag, shift = (groups.field(i).to_numpy() for i in range(3))
            anchors, anchor_at = groups.field(3).values, groups.field(3).offsets.to_numpy()
            first, windows, place, keys = (anchors.field(i).to_numpy() for i in range(4))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(texts):
                words, found = text.encode().split(), []
                for g in range(group_at[i], group_at[i + 1]):
                    s = slice(anchor_at[g], anchor_at[g + 1])
                    held = pieces.get((i, origin[g], origin_tag[g], shift[g]), [])
                    found += extend(words, held, first[s], windows[s], place[s], keys[s], bool(origin[g] < ids[i]))
                for row in set(found):
                    for column, value in zip(out, (row[0], ids[i], tags[i], *row[1:]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values(), strict=True)], names=list(kinds))

    def piece_groups(column: pa.ListArray) -> dict[tuple, list[tuple[int, bytes]]]:
        at, flat = np.diff(column.offsets.to_numpy()), column.values
        row = np.repeat(np.arange(len(at)), at).tolist()
        fields = [flat.field(k).to_pylist() for k in range(5)]
        held: dict[tuple, list] = {}
        for r, origin, origin_tag, shift, place, words in zip(row, *fields, strict=True):
            held.setdefault((r, origin, origin_tag, shift), []).append((place, words.encode()))
        return held

    def extend(words: list[bytes], pieces: list, first, windows, place, keys, remove: bool) -> list[tuple]:
        """Rows (key, place, first, windows, until) of one document and origin on a diagonal."""
        starts, ends = equal_runs(words, pieces)
        if not len(starts):
            return []
        stop = first + windows + (length - 1)
        run = np.searchsorted(starts, place, "right") - 1
        inside = (run >= 0) & (ends[run] > place)
        left, right = np.where(inside, np.maximum(starts[run], first), place), np.where(inside, np.minimum(ends[run], stop), place)
        out: list[tuple] = []
        if remove and (long := right - left >= length).any():
            a, b = left[long], right[long]  # matches of neighbouring anchors overlap: one range for each that they make
            reach = np.maximum.accumulate(b)
            head = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
            out += [(None, None, x, None, y) for x, y in zip(a[head].tolist(), reach[np.append(head[1:], len(a)) - 1].tolist(), strict=True)]
        for j in np.flatnonzero(inside & ((left > first) | (right < stop))).tolist():
            a, b, f, n, p = int(left[j]), int(right[j]), int(first[j]), int(windows[j]), int(place[j])
            if a > f:  # windows that hold the word on which the match breaks off to the left
                out.append((longer_key(int(keys[j]), False, p - a, words[a - 1]), p, f, min(a, f + n) - f, None))
            begin = max(a, b - length + 1)
            if begin < f + n:  # the others that hold the word on which it breaks off to the right
                out.append((longer_key(int(keys[j]), True, b - p, words[b]), p, begin, f + n - begin, None))
        return out

    return both.mapInArrow(run, ", ".join(f"{n} {'int' if t == pa.int32() else 'long'}" for n, t in kinds.items()))


def repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(id, tag, first, until): maximal repeats of a document of smaller id."""
    anchors, found = seeds(texts, "word", length, seed).drop("segment"), None
    while True:
        got = cut(extended(texts, met_anchors(anchors), length, block), "extended")
        spans = got.where("until is not null").select("id", "tag", "first", "until")
        found = spans if found is None else found.unionAll(spans)
        anchors = got.where("until is null").drop("until")
        if anchors.isEmpty():
            return found


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = True
) -> DataFrame:
    """(id, tag, n_symbols, n_removed, n_spans, kept_sha256[, kept_text]), one row per document; words joined by one space."""
    texts = filed(keyed_texts(docs, id_col, text_col))
    spans = repeats(texts, length, seed).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "until")).alias("spans"))
    return without_spans(texts, cut(spans, "spans"), "word", with_text)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with shortened texts and all their other columns; a document of which nothing is left goes.

    Texts that lose nothing stay as they are, blanks included.
    """
    found = substring_dedup(docs, id_col, text_col, **options).where("n_removed > 0").select(
        F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("kept_text").alias("__kept")
    ).dropDuplicates(["__id", "__tag"])
    marked = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("__id"), tag_of(docs[text_col]).alias("__tag")
    )
    row = F.col("row")
    new = F.coalesce(F.col("__kept"), row[text_col].cast("string")).alias(text_col)
    left = marked.join(found, ["__id", "__tag"], "left").where("__kept is null or __kept <> ''")
    return left.select(*[new if c == text_col else row[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = substring_dedup(docs, with_text=False)
    return found.select(real_id().alias("doc_id"), F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256", "n_spans")
