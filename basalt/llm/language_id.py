"""Language identification by a bit-sliced Bloom filter of n-grams with language bitmasks.

Learning counts in how many sample documents of each language a character n-gram occurs; an n-gram belongs to a language if
it is there often enough and not far rarer than in its strongest language. Belonging n-grams enter one Bloom filter whose
slots hold a bit per language, so that the conjunction of an n-gram's slots returns all its languages at once. A text's
n-grams give a popcount per language, which is corrected for that language's false-positive rate; the largest decides.

The fit reads a bounded sample (SAMPLE documents expected per language) of every language that occurs, and keeps at most GRAMS
n-grams of each, those in most of its documents; the model grows with the number of languages alone. Prediction reads every
text whole and needs no shuffle.

Defined cases: a null text and one without letters are `und` with score 0; a text with no known n-gram gets the commonest
language with score 0; ties go to the language that sorts first; rows with null language or id are predicted but not
learned from (a null id is not held out); repeated rows are predicted alike; if no row can be learned from all are `und`;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import cut, mix

SAMPLE, GRAMS, RELATIVE = 1500, 20_000, 0.25
#: An n-gram has to be in so many sample documents of a language: one, and one more for each of these numbers of documents that it has.
LEAST_AT = (30, 100)
#: Documents by which a language's sample is taken to be larger, so that few documents make no n-gram look certain.
SHRINK = 5
SIZES, SLOTS_PER_GRAM, HASHES = (3, 4), 16, 3
_tables: dict[str, np.ndarray] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def letter_codes() -> np.ndarray:
    """For every code point, that of its lower case if it is a letter, else that of a space."""
    if "letters" not in _tables:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def gram_hashes(texts: list[str], sizes=SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of all n-grams, and the number of letters per text. Words are framed by single blanks."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    blank = np.array([32], dtype=np.uint32)
    parts = [x for c in codes for x in (blank, c)]
    flat = letter_codes()[np.concatenate([*parts, blank])]
    doc = np.repeat(np.arange(len(texts) + 1), [*[len(c) + 1 for c in codes], 1])
    letters = np.bincount(doc[flat != 32], minlength=len(texts))[: len(texts)]
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (doc[1:] != doc[:-1])
    flat, doc = flat[keep].astype(np.uint64), doc[keep]
    hashes, docs = [], []
    for n in sizes:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        inner = np.zeros(m, dtype=bool)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + flat[i : i + m]
            if 0 < i < n - 1 or n == 1:
                inner |= flat[i : i + m] == 32
        some = ~inner & (doc[:m] == doc[n - 2 : n - 2 + m])  # the last code may be the blank that ends the text
        hashes.append(mix(h[some]))
        docs.append(doc[:m][some])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    return np.concatenate(hashes), np.concatenate(docs), letters


def text_groups(column, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow column in groups of about `most` characters, with the number of the first."""
    group, size, begun = [], 0, 0
    for i, x in enumerate(column):
        group.append(x.as_py() or "")
        size += len(group[-1])
        if size >= most:
            yield begun, group
            group, size, begun = [], 0, i + 1
    if group:
        yield begun, group


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # (size, words) uint64: language l is bit l % 64 of word l // 64
    false_rate: np.ndarray
    common: int

    @classmethod
    def build(cls, languages: list[str], common: int, grams: np.ndarray, language: np.ndarray) -> Model:
        """grams uint64 and the number of a language each belongs to, a pair per row."""
        size = 1 << max(10, int(SLOTS_PER_GRAM * max(1, len(np.unique(grams)))).bit_length())
        slots = np.zeros((size, -(-max(1, len(languages)) // 64)), dtype=np.uint64)
        for k in range(HASHES):
            np.bitwise_or.at(slots, (cls.at(grams, k, size), language // 64), np.uint64(1) << (language % 64).astype(np.uint64))
        filled = [float(np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(languages))]
        return cls(languages, slots, np.array(filled) ** HASHES, common)

    @staticmethod
    def at(grams: np.ndarray, k: int, size: int) -> np.ndarray:
        return ((grams + np.uint64(k) * ((grams >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, doc, letters = gram_hashes(texts)
        n = np.bincount(doc, minlength=len(texts))[: len(texts)]
        masks = self.slots[self.at(grams, 0, len(self.slots))]
        for k in range(1, HASHES):
            masks = masks & self.slots[self.at(grams, k, len(self.slots))]
        hits = np.zeros((len(texts), len(self.languages)))
        for i, rate in enumerate(self.false_rate):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            count = np.bincount(doc, weights=bit, minlength=len(texts))[: len(texts)]
            hits[:, i] = np.maximum(0, (count - n * rate) / (1 - rate)) if rate < 1 else 0
        total = hits.sum(axis=1)
        best = np.where(total > 0, hits.argmax(axis=1), self.common)
        score = np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        known = letters > 0
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    totals = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    counted = totals.orderBy(F.desc("n"), "lang").collect()  # a row per language
    if not counted:
        return None
    languages = sorted(r["lang"] for r in counted)
    share = totals.select("lang", (F.least(F.lit(1.0), SAMPLE / F.col("n")) * (1 << 30)).cast("long").alias("share"))
    draw = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30))
    sample = rows.join(F.broadcast(share), "lang").where(draw < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for begun, texts in text_groups(batch.column(0)):
                grams, doc, _ = gram_hashes(texts)
                lang = langs[begun + doc]
                once = np.unique(grams ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]  # a gram counts once a document
                grams, lang = grams[once], lang[once]
                _, first, n = np.unique(grams ^ mix(lang.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang[first].astype(np.int32)), pa.array(grams[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "docs"]
                )

    found = sample.select("text", "lang").mapInArrow(count, "lang int, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    sizes = spark.createDataFrame([(languages.index(r["lang"]), float(min(r["n"], SAMPLE))) for r in counted], "lang int, size double")
    least = sum((F.when(F.col("size") >= n, 1).otherwise(0) for n in LEAST_AT), F.lit(1))
    rated = found.join(F.broadcast(sizes), "lang").where(F.col("docs") >= least).withColumn("rate", F.col("docs") / (F.col("size") + SHRINK))
    rated = cut(rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= F.col("top") * RELATIVE).select("lang", "gram", "docs"), "rated")
    # the number of documents that leaves at most GRAMS: a window over a language's few such numbers, not over its n-grams
    at_most = rated.groupBy("lang", "docs").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("docs"))))
    bound = at_most.where(F.col("above") <= GRAMS).groupBy("lang").agg(F.min("docs").alias("bound"))
    best = rated.join(F.broadcast(bound), "lang").where("docs >= bound")
    table = best.select("lang", "gram").toArrow()
    common = languages.index(counted[0]["lang"])
    return Model.build(languages, common, table.column("gram").to_numpy().view(np.uint64), table.column("lang").to_numpy().astype(np.int64))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id_col, held_out, lang_pred, score), one row per document."""
    import pyarrow as pa

    model = model or fit(docs, id_col, text_col, lang_col)
    own = docs.select(docs[id_col], held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    if model is None:
        return own.select(id_col, "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = own.sparkSession.sparkContext.broadcast(model)  # at most GRAMS n-grams a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in text_groups(batch.column(2)):
                langs, score = shared.value.predict(texts)
                part = batch.slice(begun, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
