"""Line framing, the fetch request language, signed links and text diffs."""

from __future__ import annotations

import difflib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass, field

FLUSH, DELIM, END = "flush", "delim", "end"
_SPECIAL = {0: FLUSH, 1: DELIM, 2: END}
#: Largest payload of a side-band line.
BAND = 65_515


def frame(payload: bytes) -> bytes:
    if len(payload) > 65_516:
        raise ValueError("payload too long for a line")
    return f"{len(payload) + 4:04x}".encode() + payload


def frames(data: bytes) -> Iterator[bytes | str]:
    """Payloads, and the names of flush, delimiter and end lines."""
    at = 0
    while at < len(data):
        n = int(data[at : at + 4], 16)
        if n in _SPECIAL:
            yield _SPECIAL[n]
            at += 4
        elif n < 4 or at + n > len(data):
            raise ValueError(f"bad line length {n} at {at}")
        else:
            yield data[at + 4 : at + n]
            at += n


def banded(data: bytes, band: int = 1) -> Iterator[bytes]:
    for at in range(0, len(data), BAND):
        yield frame(bytes([band]) + data[at : at + BAND])


@dataclass
class Fetch:
    """A fetch request; its fields name the inputs of graph.send_set, depth_cut, time_cut and the blob filter."""

    wants: list[str] = field(default_factory=list)
    want_refs: list[str] = field(default_factory=list)
    haves: list[str] = field(default_factory=list)
    shallow: list[str] = field(default_factory=list)
    deepen: int | None = None
    deepen_since: int | None = None
    deepen_not: list[str] = field(default_factory=list)
    filter: str | None = None
    flags: set[str] = field(default_factory=set)


_FLAGS = {"done", "thin-pack", "no-progress", "include-tag", "ofs-delta", "deepen-relative", "wait-for-done", "sideband-all"}
_LISTS = {"want": "wants", "want-ref": "want_refs", "have": "haves", "shallow": "shallow", "deepen-not": "deepen_not"}


def parse_fetch(lines: list[str]) -> Fetch:
    """Argument lines to a request; unknown lines and contradictory depths raise ValueError."""
    out = Fetch()
    for line in (x.rstrip("\n") for x in lines):
        word, _, rest = line.partition(" ")
        if word in _LISTS and rest:
            getattr(out, _LISTS[word]).append(rest)
        elif word == "deepen" and rest.isdigit() and int(rest) > 0:
            out.deepen = int(rest)
        elif word == "deepen-since" and rest.isdigit():
            out.deepen_since = int(rest)
        elif word == "filter" and (rest == "blob:none" or rest.startswith("blob:limit=")):
            out.filter = rest
        elif line in _FLAGS:
            out.flags.add(line)
        else:
            raise ValueError(f"unknown argument: {line}")
    if out.deepen is not None and (out.deepen_since is not None or out.deepen_not):
        raise ValueError("deepen excludes deepen-since and deepen-not")
    return out


def blob_limit(text: str) -> int:
    """Largest size that a filter lets pass; none lets no blob pass (-1). Suffixes k, m and g."""
    if text == "blob:none":
        return -1
    number = text.removeprefix("blob:limit=").lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(number[-1:], 1)
    return int(number.rstrip("kmg")) * scale


def parse_command(line: bytes) -> tuple[str | None, str | None, str, list[str]]:
    """`old new name NUL capabilities` -> (old, new, name, capabilities); all-zero ids are None."""
    body, _, caps = line.rstrip(b"\n").partition(b"\0")
    old, new, name = body.decode().split(" ", 2)
    null = lambda x: None if set(x) == {"0"} else x
    if len(old) != len(new) or len(old) not in (40, 64):
        raise ValueError("bad object id")
    return null(old), null(new), name, caps.decode().split()


def signature(secret: bytes, *fields: object) -> str:
    """HMAC-SHA256 over fields, each framed by its length, so that no two lists sign alike."""
    text = b"".join(frame(str(f).encode()) for f in fields)
    return hmac.new(secret, text, "sha256").hexdigest()


def signature_valid(secret: bytes, given: str, now: int, expires: int, *fields: object) -> bool:
    return now < expires and hmac.compare_digest(given, signature(secret, *fields, expires))


def unified(old: str, new: str, name: str = "file") -> str:
    return "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{name}", f"b/{name}", lineterm=""))


def blame(versions: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(author, text) from oldest to newest -> (author, line) of the newest: equal lines keep their author."""
    known: list[tuple[str, str]] = []
    for author, text in versions:
        lines = text.splitlines()
        after = [(author, line) for line in lines]
        for block in difflib.SequenceMatcher(None, [k[1] for k in known], lines, autojunk=False).get_matching_blocks():
            after[block.b : block.b + block.size] = known[block.a : block.a + block.size]
        known = after
    return known
