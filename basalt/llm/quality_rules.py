"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths measure which characters of a text lie inside n-grams of words or lines that the
text repeats; equal hashes are verified on bytes. Each length has its own limit: long n-grams rarely repeat in prose, so less
of the text may lie in them.

Defined cases: a null or blank text has no words, all counts zero, and fails the base rule; a text is judged by itself
alone, so ties, repeated rows and other columns do not matter; texts of any length are read whole (memory is in proportion
to the longest text); an empty table gives an empty result. Columns other than the id and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import BYTE_VALUE, Rolling, chunks, covered, mix, repeated, same_bytes, text_buffer, words_of

#: n-gram length in words -> largest share of the word characters that repeated n-grams of that length may cover.
COVERAGE = {5: 0.50, 8: 0.45, 12: 0.40}
#: Largest share of the word characters that repeated lines (after their first) may cover.
LINE_COVERAGE = 0.30
SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "line_coverage double, ngram_coverage double"
)


def measure(data: np.ndarray, bounds: np.ndarray, coverage: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """The rules' figures for the documents [bounds[i], bounds[i + 1]) of data."""
    n, n_docs = len(data), len(bounds) - 1
    starts, ends, first = words_of(data, bounds)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    rolling = Rolling(BYTE_VALUE[data])
    word = rolling.of(starts, ends)
    points = np.zeros(n + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    per_doc = lambda w: np.bincount(doc, weights=w, minlength=n_docs).astype(np.int64)
    word_chars = per_doc(chars)
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    marks = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(symbol[data], out=marks[1:])
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64))

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < n]
    line_ends = np.append(line_starts[1:], n)[: len(line_starts)]
    line_ends = line_ends - ((line_ends > line_starts) & (data[line_ends - 1] == 10))
    lo, hi = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = hi > lo
    lo, hi, line_starts, line_ends = lo[full], hi[full], line_starts[full], line_ends[full]
    line_doc = doc[lo]

    def numbered(items) -> np.ndarray:
        seen: dict = {}
        return np.array([seen.setdefault(x, len(seen)) for x in items], dtype=np.int64)

    raw = memoryview(data)
    _, later = repeated(
        rolling.of(line_starts, line_ends) ^ salt[line_doc],
        lambda i, j: bool((line_doc[i] == line_doc[j]).all()) and same_bytes(data, line_starts[i], line_ends[i], line_starts[j], line_ends[j]),
        lambda: numbered((d, raw[a:b].tobytes()) for d, a, b in zip(line_doc.tolist(), line_starts.tolist(), line_ends.tolist(), strict=True)),
    )
    n_dup_lines = np.bincount(line_doc[later], minlength=n_docs)
    in_line = covered(lo[later], hi[later], len(starts))

    grams = Rolling(word)

    def in_grams(k: int) -> np.ndarray:
        at = np.arange(max(0, len(word) - k + 1))
        at = at[doc[at] == doc[at + k - 1]] if len(at) else at
        again, _ = repeated(
            grams.of(at, at + k) ^ salt[doc[at]],
            lambda i, j: bool((doc[at[i]] == doc[at[j]]).all()) and all(same_bytes(data, starts[at[i] + t], ends[at[i] + t], starts[at[j] + t], ends[at[j] + t]) for t in range(k)),
            lambda: numbered((doc[x], *(raw[a:b].tobytes() for a, b in zip(starts[x : x + k].tolist(), ends[x : x + k].tolist(), strict=True))) for x in at.tolist()),
        )
        return covered(at[again], at[again] + k, len(word))

    repeat_words = per_doc(in_grams(3))
    base_failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    total = np.maximum(word_chars, 1)
    line_share = per_doc(chars * in_line) / total
    kept, most = ~base_failed & (line_share <= line_limit), np.zeros(n_docs)
    for k, limit in coverage.items():
        share = per_doc(chars * in_grams(k)) / total
        kept &= share <= limit
        most = np.maximum(most, share)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": marks[bounds[1:]] - marks[bounds[:-1]], "n_dup_lines": n_dup_lines,
        "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": kept, "line_coverage": line_share, "ngram_coverage": most,
    }


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: dict[int, float] = COVERAGE,
    line_coverage: float = LINE_COVERAGE, keep_columns: list[str] | None = None,
) -> DataFrame:
    """One row per document: `keep_columns` (the id alone by default), counts, coverage and `kept`. No shuffle."""
    import pyarrow as pa

    keep = keep_columns or [id_col]
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("__text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            for i, j in chunks(offsets):
                got = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], coverage, line_coverage)
                own = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, got.values())], names=[*keep, *got])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(judge, f"{own}, {SCHEMA}")


def kept_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that pass, with all their columns; carried as one struct, so that no name clashes."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    return quality_rules(rows, text_col="text", keep_columns=["row"], **options).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs)
