import zlib

import pytest

from basalt.sources import packs, wire


def delta(base: bytes, parts: list) -> bytes:
    def number(n):
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    body, size = b"", 0
    for p in parts:
        if isinstance(p, bytes):
            body, size = body + bytes([len(p)]) + p, size + len(p)
        else:
            start, n = p
            body, size = body + bytes([0x80 | 1 | 16]) + bytes([start, n]), size + n
    return number(len(base)) + number(size) + body


def with_deltas() -> bytes:
    """blob, a delta on it by distance, a delta on that by id, and one whose base is missing."""
    from hashlib import sha1

    base, out = b"hello old world", b"PACK" + (2).to_bytes(4, "big") + (4).to_bytes(4, "big")
    first = len(out)
    out += packs.encode_entry(3, base)
    second = len(out)
    d1 = delta(base, [(0, 6), b"new", (9, 6)])
    out += bytes([6 << 4 | len(d1) & 15 | 128, len(d1) >> 4]) + bytes([second - first]) + zlib.compress(d1)
    made = packs.apply_delta(base, d1)
    for target in (packs.object_id(3, made), "ab" * 20):
        d2 = delta(made, [(0, len(made)), b"!"])
        out += bytes([7 << 4 | len(d2) & 15 | 128, len(d2) >> 4]) + bytes.fromhex(target) + zlib.compress(d2)
    return out + sha1(out).digest()


def test_pack_round_trip_and_deltas(spark, tmp_path):
    objects = [(3, b""), (3, b"x" * 5000), (1, b"tree " + b"a" * 40 + b"\nparent " + b"b" * 40 + b"\n\nmessage")]
    (tmp_path / "a.pack").write_bytes(packs.write_pack(objects))
    (tmp_path / "b.pack").write_bytes(with_deltas())
    found = packs.read_packs(spark, str(tmp_path))
    assert found.count() == 7
    got = {bytes(r.body): r.level for r in packs.resolved(found).collect()}
    assert got == {b"": 0, b"x" * 5000: 0, objects[2][1]: 0, b"hello old world": 0, b"hello new world": 1, b"hello new world!": 2}
    spark.dataSource.register(packs.PackSource)
    assert spark.read.format("pack").option("path", str(tmp_path)).load().count() == 7
    assert packs.links_of(1, objects[2][1]) == ["a" * 40, "b" * 40]


@pytest.mark.parametrize("damage", [lambda b: b[:-1] + b"\0", lambda b: b"PUCK" + b[4:], lambda b: b[:40]])
def test_damaged_packs_are_refused(damage):
    with pytest.raises(packs.BadPack):
        list(packs.entries(damage(packs.write_pack([(3, b"body" * 20)]))))


def test_lines_requests_and_signatures():
    data = wire.frame(b"want x\n") + b"0001" + wire.frame(b"done") + b"0000"
    assert list(wire.frames(data)) == [b"want x\n", "delim", b"done", "flush"]
    assert b"".join(x[5:] for x in wire.banded(b"z" * 70_000)) == b"z" * 70_000
    ask = wire.parse_fetch(["want a\n", "have b", "deepen 3", "filter blob:limit=2k", "done"])
    assert (ask.wants, ask.haves, ask.deepen, wire.blob_limit(ask.filter), ask.flags) == (["a"], ["b"], 3, 2048, {"done"})
    for bad in (["frob"], ["deepen 1", "deepen-since 5"], ["deepen 0"]):
        with pytest.raises(ValueError):
            wire.parse_fetch(bad)
    assert wire.parse_command(b"0" * 40 + b" " + b"a" * 40 + b" refs/heads/x\0report-status") == (None, "a" * 40, "refs/heads/x", ["report-status"])
    signed = wire.signature(b"k", "repo", "pack", 99)
    assert wire.signature_valid(b"k", signed, 50, 99, "repo", "pack") and not wire.signature_valid(b"k", signed, 99, 99, "repo", "pack")
    assert wire.blame([("ann", "a\nb"), ("bo", "a\nc\nb")]) == [("ann", "a"), ("bo", "c"), ("ann", "b")]
