"""Helpers that the corpus operators share: stage tables, Arrow text access and numpy rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; it sorts after every id and becomes null again in results.
NO_ID = 2**63 - 1
WORD = r"[^\x20\x09-\x0D]+"
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only on a local master, a temporary one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _fallback.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="basalt-"))


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage and shuffle files end there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tag_of(text: Column) -> Column:
    """Tells apart texts under one id; a null text is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text, F.length(text))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, text): id is never null, tag separates rows that repeat an id with another text; null texts are empty."""
    text = docs[text_col]
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), tag_of(text).alias("tag"), F.coalesce(text.cast("string"), F.lit("")).alias("text")
    )


def in_buckets(once: DataFrame) -> DataFrame:
    """Rows of unique (id, tag), written in buckets of id and tag; joins on them then move the other side alone.

    The number of buckets is that of the session's shuffle partitions.
    """
    spark = once.sparkSession
    name, buckets = f"texts_{uuid.uuid4().hex}", min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with freed(spark):
        once.write.format("parquet").bucketBy(buckets, "id", "tag").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are external
    return table


def filed(texts: DataFrame) -> DataFrame:
    """(id, tag, text) -> (id, tag, text, copies): a row per id and text, in buckets; rows that repeat are counted before they are shuffled."""
    return in_buckets(texts.groupBy("id", "tag").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies")))


def real_id(name: str = "id"):
    return F.when(F.col(name) != NO_ID, F.col(name))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets, without a copy where the column is one chunk."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = 1 << 16):
    """Ranges (i, j) of whole documents of about `most` bytes, whose arrays fit a processor's cache; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: The prime 2**31 - 1 and two bases below it: hashes are pairs of polynomials over its field. A modulus of 2**64 would be
#: faster, but Thue-Morse strings collide there whatever the base.
_PRIME = np.uint64(2**31 - 1)
_BASES = (1_487_136_523, 1_967_224_919)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2**62 modulo the prime."""
    y = x >> np.uint64(31)
    y += x & _PRIME
    return np.minimum(y, y - _PRIME, out=y)  # y - prime wraps around where y is the smaller


def powers(n: int) -> list[np.ndarray]:
    """For each base, base**i and its inverse modulo the prime for i <= n, kept and grown by doubling."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        made = []
        for base in _BASES:
            for b in (base, pow(base, -1, int(_PRIME))):
                table = np.ones(size, dtype=np.uint64)
                have = 1
                while have < size:
                    table[have : 2 * have] = _reduced(table[:have] * np.uint64(pow(b, have, int(_PRIME))))
                    have *= 2
                made.append(table)
        _powers[:] = made
    return _powers


class Rolling:
    """Prefix sums of two polynomials over 64-bit symbols; of(s, e) hashes any range [s, e) in constant time.

    Two unlike ranges of n symbols have equal hashes with a probability of at most about (n / 2**31)**2.
    """

    def __init__(self, values: np.ndarray):
        self.tables = powers(len(values))
        self.sums = []
        for half, up in ((values & _PRIME, self.tables[0]), (values >> np.uint64(33), self.tables[2])):
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(_reduced(half * up[: len(values)]), out=sums[1:])
            self.sums.append(_reduced(sums))

    def _joined(self, ends: list[np.ndarray], starts: list[np.ndarray], at, salt) -> np.ndarray:
        a, b = (_reduced(_reduced(e + _PRIME - s) * down[at]) for e, s, down in zip(ends, starts, self.tables[1::2], strict=True))
        return mix((a << np.uint64(32) | b) + salt)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._joined([s[end] for s in self.sums], [s[start] for s in self.sums], start, (end - start).astype(np.uint64) * _GOLDEN)

    def every(self, n: int) -> np.ndarray:
        """Hashes of all ranges of n symbols."""
        m = len(self.sums[0]) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        return self._joined([s[n:] for s in self.sums], [s[:-n] for s in self.sums], slice(0, m), np.uint64(n * int(_GOLDEN) % (1 << 64)))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents [bounds[i], bounds[i + 1]) in data, and each document's first word.

    A word is a run of bytes other than ASCII space and 0x09-0x0D and never crosses a document's border.
    """
    full = ~_BLANK[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = full[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = False
    starts = np.flatnonzero(full & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = full[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> bool:
    """Whether all ranges [a, a_end) of data equal the ranges [b, b_end), byte by byte."""
    n = a_end - a
    if (n != b_end - b).any():
        return False
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((data[np.repeat(a, n) + step] == data[np.repeat(b, n) + step]).all())


def repeated(keys: np.ndarray, equal=None, exact=None) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: keys that occur twice or more, and occurrences after the first in array order.

    Where keys are hashes, equal(i, j) tells whether all items i are those of j, and exact() gives keys that are no hashes; they are
    used if two unlike items have one hash.
    """
    n = len(keys)
    again, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if equal is not None and same.any() and not equal(order[:-1][same], order[1:][same]):
            return repeated(exact())
        later[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, later


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions below n that lie in any range [start, end)."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
