"""Pack files as a source and a sink: bytes to entry rows, delta resolution by levels, and rows back to bytes.

A pack is the magic `PACK`, a version and an entry count (big-endian), entries, and the SHA-1 of all before. An entry is a
variable-length head (3 bits of kind, then the size in groups of 4 and 7 bits), for deltas a base (a distance back, or an
id), and a zlib stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from basalt.functions.staging import staged

#: Fixed values of the format.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, ID_DELTA = 6, 7
ENTRY = "pack string, idx long, offset long, kind int, size long, base_offset long, base_id string, body binary"


class BadPack(ValueError):
    """The bytes are no pack."""


def size_varint(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian number in groups of 7 bits: (value, next place)."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def entries(data: bytes) -> Iterator[tuple[int, int, int, int | None, str | None, bytes]]:
    """(offset, kind, size, base offset, base id, body) of each entry; raises BadPack."""
    if len(data) < 32 or data[:4] != b"PACK" or int.from_bytes(data[4:8], "big") not in (2, 3):
        raise BadPack("no pack header")
    if sha1(data[:-20]).digest() != data[-20:]:
        raise BadPack("trailer does not match")
    at, end = 12, len(data) - 20
    for _ in range(int.from_bytes(data[8:12], "big")):
        begun = at
        if at >= end:
            raise BadPack("fewer entries than declared")
        kind, size = data[at] >> 4 & 7, data[at] & 15
        if data[at] & 128:
            high, at = size_varint(data, at + 1)
            size |= high << 4
        else:
            at += 1
        base_offset = base_id = None
        if kind == OFFSET_DELTA:
            back = data[at] & 127
            while data[at] & 128:
                at += 1
                back = (back + 1 << 7) | (data[at] & 127)
            at += 1
            base_offset = begun - back
        elif kind == ID_DELTA:
            base_id, at = data[at : at + 20].hex(), at + 20
        stream = zlib.decompressobj()
        try:
            body = stream.decompress(data[at:end])
        except zlib.error as failed:
            raise BadPack(f"entry at {begun}: {failed}") from failed
        if not stream.eof or len(body) != size:
            raise BadPack(f"entry at {begun} has another size")
        at = end - len(stream.unused_data)
        yield begun, kind, size, base_offset, base_id, body
    if at != end:
        raise BadPack("bytes after the last entry")


def encode_entry(kind: int, body: bytes) -> bytes:
    size = len(body)
    head = bytearray([kind << 4 | size & 15])
    size >>= 4
    while size:
        head[-1] |= 128
        head.append(size & 127)
        size >>= 7
    return bytes(head) + zlib.compress(body)


def write_pack(objects: list[tuple[int, bytes]]) -> bytes:
    """A pack of full entries, in the order given."""
    out = b"PACK" + (2).to_bytes(4, "big") + len(objects).to_bytes(4, "big") + b"".join(encode_entry(k, b) for k, b in objects)
    return out + sha1(out).digest()


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """Copy and insert instructions over a base."""
    expected, at = size_varint(delta, 0)
    size, at = size_varint(delta, at)
    if expected != len(base):
        raise BadPack("delta of another base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            fields = []
            for bit in range(7):
                fields.append(delta[at] if op >> bit & 1 else 0)
                at += op >> bit & 1
            start, length = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 65536
            if start + length > len(base):
                raise BadPack("copy beyond the base")
            out += base[start : start + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise BadPack("reserved instruction")
    if len(out) != size:
        raise BadPack("delta gives another size")
    return bytes(out)


def object_id(kind: int, body: bytes) -> str:
    return sha1(f"{KINDS[kind]} {len(body)}".encode() + b"\0" + body).hexdigest()


def links_of(kind: int, body: bytes) -> list[str]:
    """Ids an object refers to: a commit's tree and parents, a tree's entries but submodules, a tag's target."""
    if kind == 2:
        found, at = [], 0
        while at < len(body):
            zero = body.index(b"\0", at)
            if not body.startswith(b"160000 ", at):
                found.append(body[zero + 1 : zero + 21].hex())
            at = zero + 21
        return found
    if kind in (1, 4):
        heads = [line.split(b" ", 1) for line in body.split(b"\n\n", 1)[0].split(b"\n")]
        return [h[1].decode() for h in heads if h[0] in ((b"tree", b"parent") if kind == 1 else (b"object",))]
    return []


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Entry rows of all pack files of a folder; a pack is one task's row. Works with every store that Spark reads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["offset", "kind", "size", "base_offset", "base_id", "body"]
        for frame in frames:
            for pack, data in zip(frame["path"], frame["content"], strict=True):
                rows = pd.DataFrame(list(entries(bytes(data))), columns=names)
                rows.insert(0, "idx", range(len(rows)))
                rows.insert(0, "pack", pack)
                rows["base_offset"] = rows["base_offset"].astype("Int64")
                yield rows

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ENTRY)


def resolved(found: DataFrame, most: int = 64) -> DataFrame:
    """Entry rows -> (id, kind, body, level): deltas applied level by level; missing bases and cycles never resolve and are absent."""
    schema = "pack string, offset long, id string, kind int, body binary, level int"

    def full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["id"] = [object_id(k, bytes(b)) for k, b in zip(f["kind"], f["body"], strict=True)]
            yield f.assign(level=0)[["pack", "offset", "id", "kind", "body", "level"]]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["body"] = [apply_delta(bytes(b), bytes(d)) for b, d in zip(f["base_body"], f["body"], strict=True)]
            f["id"] = [object_id(k, b) for k, b in zip(f["kind"], f["body"], strict=True)]
            yield f[["pack", "offset", "id", "kind", "body", "level"]]

    deltas = found.where(F.col("kind").isin(OFFSET_DELTA, ID_DELTA)).select("pack", "offset", "base_offset", "base_id", "body")
    done = [staged(found.where("kind <= 4").select("pack", "offset", "kind", "body").mapInPandas(full, schema))]
    for level in range(1, most + 1):
        last = done[-1].select(F.col("pack").alias("base_pack"), F.col("offset").alias("at"), "id", "kind", F.col("body").alias("base_body"))
        near = deltas.where("base_offset is not null").join(last, (F.col("pack") == F.col("base_pack")) & (F.col("base_offset") == F.col("at")))
        far = deltas.where("base_id is not null").join(last.dropDuplicates(["id"]), F.col("base_id") == F.col("id"))
        both = near.unionByName(far).select("pack", "offset", "kind", "body", "base_body", F.lit(level).alias("level")).dropDuplicates(["pack", "offset"])
        new = staged(both.mapInPandas(step, schema))
        if new.isEmpty():
            break
        done.append(new)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select("id", "kind", "body", "level")


class PackSource(DataSource):
    """`spark.read.format("pack").option("path", ..)`: entry rows of pack files in a folder that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return PackReader(self.options["path"])


class PackReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.pack"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pathlib import Path

        for i, row in enumerate(entries(Path(partition.value).read_bytes())):
            yield (partition.value, i, *row)
