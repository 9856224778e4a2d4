"""Places where repeats of at least `length` symbols can lie, found from winnowed seeds (Schleimer et al., 2003).

A symbol is a byte or a word. Of the seed hashes inside each window of `length` symbols the smallest (leftmost if tied) is
the window's seed. Equal windows choose equal seeds at equal offsets, so every window is looked for only among the windows of
its own seed, and the windows that chose one occurrence of a seed are neighbours: a *segment*, the widest stretch to which
this occurrence has to be extended.

The callers differ in how they compare segments. No step pairs the members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import BYTE_VALUE, Rolling, chunks, mix, text_buffer, words_of

_LOW = np.uint64(0xFFFFFFFF)
#: Copies of a row that one task writes; the result of a row of more copies is dealt out in blocks of so many.
COPIES = 1000


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in linear time."""
    n = len(values)
    if n < w:
        return values[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, w).T.copy()
    before = np.minimum.accumulate(rows, axis=0).T.reshape(-1)
    after = np.minimum.accumulate(rows[::-1], axis=0)[::-1].T.reshape(-1)
    m = n - w + 1
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def segments(rolling: Rolling, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, seed place, first window, windows, seed hash) of all segments; bounds: each document's first symbol."""
    grams = rolling.every(seed)
    if len(grams) < length - seed + 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    place = (sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - seed + 1) & _LOW).astype(np.int64)
    sizes = np.diff(bounds) - length + 1
    valid = np.zeros(len(place) + 1, dtype=np.int64)
    has = sizes > 0
    np.add.at(valid, bounds[:-1][has], 1)
    np.add.at(valid, bounds[:-1][has] + sizes[has], -1)
    at = np.flatnonzero(np.cumsum(valid)[:-1])
    if not len(at):
        return segments(Rolling(np.zeros(0, np.uint64)), np.zeros(1, np.int64), length, seed)
    head = np.concatenate([[0], np.flatnonzero(place[at[1:]] != place[at[:-1]]) + 1])
    first = at[head]
    windows = np.diff(np.append(head, len(at)))
    return np.searchsorted(bounds, first, "right") - 1, place[first], first, windows, grams[place[first]]


def symbols(data: np.ndarray, bounds: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol values, each document's first symbol, and the symbols' starts and ends in data."""
    if unit == "byte":
        at = np.arange(len(data) + 1)
        return BYTE_VALUE[data], bounds, at[:-1], at[1:]
    starts, ends, first = words_of(data, bounds)
    return Rolling(BYTE_VALUE[data]).of(starts, ends), first, starts, ends


def signed(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def seeds(texts: DataFrame, unit: str, length: int, seed: int, keys_only: bool = False) -> DataFrame:
    """(id, tag, text) -> (key, segment, id, tag, place, first, windows): a row per segment, with the hashes of its seed and of itself.

    The seed is at `place`, the first of the `windows` windows that chose it at `first`, counted in the document's own symbols.
    keys_only: the column `key` alone, which is all that counting takes.
    """
    import pyarrow as pa

    names = ["key", "segment", "id", "tag", "place", "first", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in chunks(offsets):
                values, bounds, _, _ = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                rolling = Rolling(values)
                doc, place, first, windows, hashed = segments(rolling, bounds, length, seed)
                if keys_only:
                    yield pa.RecordBatch.from_arrays([signed(hashed)], names=["key"])
                    continue
                whole = mix(rolling.of(first, first + windows + (length - 1)) ^ mix((place - first).astype(np.uint64)))
                base = bounds[doc]
                columns = [hashed, whole, ids[i:j][doc], tags[i:j][doc], place - base, first - base, windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([signed(c) for c in columns], names=names)

    return texts.mapInArrow(run, "key long" if keys_only else "key long, segment long, id long, tag long, place long, first long, windows int")


def list_column(batch, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of an Arrow list<struct> column, counted from its first row, and the fields' values."""
    column = batch.column(i)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = column.flatten()
    return offsets - offsets[0], [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]


def without_spans(texts: DataFrame, spans: DataFrame, unit: str, with_text: bool) -> DataFrame:
    """(id, tag, n_symbols, n_removed, n_spans, kept_sha256[, kept_text]), `copies` times for each filed text.

    What stays is joined by one space where the unit is a word, by nothing where it is a byte; kept_text replaces bytes that
    no longer form a character by U+FFFD.
    """
    from hashlib import sha256

    import pyarrow as pa

    names = ["id", "tag", "copies", "n_symbols", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]
    gap = b" " if unit == "word" else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                yield cut_out(whole.slice(i, 500))

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column(2))
        column = batch.column(3)
        spans_at, (first_of, until_of) = list_column(batch, 3) if column.null_count < len(column) else (np.zeros(batch.num_rows + 1, np.int64), (np.zeros(0, np.int64),) * 2)
        out: list[list] = [[] for _ in names[3:]]
        for i in range(batch.num_rows):
            text, lo, hi = data[offsets[i] : offsets[i + 1]].tobytes(), spans_at[i], spans_at[i + 1]
            parts = text.split() if unit == "word" else text
            n, gone, runs, kept = len(parts), 0, 0, parts
            if hi > lo:
                order = np.argsort(first_of[lo:hi])
                first, until = first_of[lo:hi][order], np.maximum.accumulate(until_of[lo:hi][order])
                head = np.concatenate([[True], first[1:] > until[:-1]])
                starts, ends = first[head].tolist(), until[np.append(head[1:], True)].tolist()
                gone, runs = sum(ends) - sum(starts), len(starts)
                pieces = [parts[a:b] for a, b in zip([0, *ends], [*starts, n], strict=True)]
                kept = [w for p in pieces for w in p] if unit == "word" else b"".join(pieces)
            kept = gap.join(kept) if unit == "word" else kept
            for o, v in zip(out, [n, gone, runs, sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * with_text], strict=True):
                o.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *[pa.array(o, t) for o, t in zip(out, types, strict=False)]], names=names)

    schema = "id long, tag long, copies long, n_symbols long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    both = texts.join(spans, ["id", "tag"], "left").select("id", "tag", "text", "spans", "copies")
    copies = F.col("copies")
    few = both.where(copies <= COPIES).mapInArrow(run, schema).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    many = both.where(copies > COPIES).mapInArrow(run, schema).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((copies - 1) / COPIES))))
    many = many.repartition("id", "tag", "block").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), copies - F.col("block") * COPIES))))
    return few.unionByName(many.drop("block")).drop("copies", "copy")
