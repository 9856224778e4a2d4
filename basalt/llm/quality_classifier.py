"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; unlabelled web text is a sample of the documents without a label. A logistic model over
standardised text statistics minimises the non-negative unbiased risk (Kiryo et al., 2017)

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

Where the second term turns negative, a step raises it again instead of fitting noise. The class prior is estimated from the same
two samples by best bins (Garg et al., 2021): a logistic model tells positives from unlabelled text on one half, and on the other
half the least ratio of unlabelled to positive rows above any score bounds the share of positives. No bad label is read.

The fit reads a bounded sample (POSITIVES and UNLABELLED documents expected); scoring reads every text whole, without a shuffle.

Defined cases: null text is empty, and an empty text is scored like any other, from zero counts; a document with conflicting
labels is no positive; rows with a null id are scored but not learned from; of an id that repeats the least text is learned from;
without any positive or unlabelled row all scores are 0.5; repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import BYTE_VALUE, Rolling, chunks, mix, repeated, text_buffer, words_of
from basalt.llm.language_id import held_out

POSITIVES, UNLABELLED, STEPS, RATE, DECAY = 6000, 12_000, 600, 0.05, 1e-4
CUT = 0.7
_MARKS = "!|%*#$&<>{}[]()=+/\\_~^@\"'?;:,.-"


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Statistics of the documents [bounds[i], bounds[i + 1]) of data, a row each."""
    n_docs, n = len(bounds) - 1, len(data)
    starts, ends, first = words_of(data, bounds)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    size = np.maximum(np.diff(bounds), 1)
    words = np.maximum(n_words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / size

    def of_words(weights: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=weights, minlength=n_docs) / words

    upper = (data >= 65) & (data <= 90)
    last, head = data[ends - 1], data[starts]
    word = Rolling(BYTE_VALUE[data]).of(starts, ends)
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64))[doc]
    grams = Rolling(word)
    at = np.arange(max(0, len(word) - 2))
    at = at[doc[at] == doc[at + 2]] if len(at) else at
    _, later = repeated(grams.of(at, at + 3) ^ salt[at])
    _, seen = repeated(word ^ salt)
    runs = np.zeros(len(word))
    runs[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    length = ends - starts
    is_mark = np.zeros(256, dtype=bool)
    is_mark[[ord(c) for c in _MARKS]] = True
    shares = [
        share(upper), share((data >= 48) & (data <= 57)), share(data >= 128), share(data == 10), *[share(data == ord(c)) for c in "!|.,?"],
        share(np.isin(data, np.frombuffer(b"%*#$&<>", np.uint8))), share(is_mark[data]), of_words(is_mark[last]), of_words((head >= 65) & (head <= 90)),
        of_words(length == 1), of_words(length > 12), np.bincount(doc[at[later]], minlength=n_docs) / words, of_words(seen), of_words(runs),
    ]
    plain = [np.log1p(n_words), of_words(length) / 10, (n_words < 50).astype(float)]
    return np.stack([*shares, *[np.log1p(200 * s) for s in shares], *plain], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, contrast: bool = False) -> np.ndarray:
    """The step's direction: the risk's gradient, or, where its second term is negative, that of the term alone turned round.

    contrast: the plain logistic risk of positives against unlabelled rows, each weighing half.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = p @ w, u @ w
    up, down_u = -(p.T @ sigmoid(-zp)) / len(p), u.T @ sigmoid(zu) / len(u)
    if contrast:
        return (up + down_u) / 2
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    down = down_u - prior * (p.T @ sigmoid(zp)) / len(p)
    return prior * up + down if negative >= 0 else -down


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, contrast: bool = False) -> Model:
    """Non-negative unbiased risk with logistic loss, by Adam on the whole sample."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        grad = risk_gradient(w, p, u, prior, contrast)
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows: the least of (share of unlabelled rows above a score) / (share of positives above it).

    Both shares carry a margin for their sampling error, so that thin tails do not decide.
    """
    if len(positive) < 8 or len(unlabelled) < 8:
        return 0.5
    model = fit_risk(positive[::2], unlabelled[::2], 0.5, steps=200, contrast=True)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    cuts = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(20) / (2 * len(p))) + np.sqrt(np.log(20) / (2 * len(u)))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(min(0.98, max(0.02, above_u[best] / above_p[best])))


def feature_rows(texts: DataFrame) -> DataFrame:
    """(kind, text) -> (kind, x)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["kind", "x"])

    return texts.mapInArrow(run, "kind int, x binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Model | None, float]:
    taught = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull() & ~held_out(labels[id_col]))
    taught = taught.groupBy(taught[id_col].cast("long").alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    totals = taught.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("low") == 1).cast("int")), F.lit(0)).alias("good")).first()
    n_docs = docs.count()
    if not totals["n"] or not n_docs:
        return None, 0.5
    part = lambda most, n: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))
    good = taught.where((F.col("low") == 1) & (F.col("high") == 1) & part(POSITIVES, totals["good"])).select("id", F.lit(1).alias("kind"))
    any_label = labels.select(labels[id_col].cast("long").alias("id")).where("id is not null").distinct()
    ids = docs.select(docs[id_col].cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    web = ids.where(part(UNLABELLED, 0.75 * max(1, n_docs - totals["n"] / 0.75))).join(any_label, "id", "left_anti").select("id", F.lit(0).alias("kind")).distinct()
    # the sample's ids are bounded by its two sizes, so their broadcast is as well
    chosen = F.broadcast(good.unionAll(web))
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # one text an id, the least one, so that what is collected is bounded even where an id repeats
    once = texts.join(chosen, "id").groupBy("id").agg(F.min("kind").alias("kind"), F.min("text").alias("text"))
    got = feature_rows(once.select("kind", "text")).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.float64).reshape(len(got), -1) if len(got) else np.zeros((0, 1))
    kind = got.column("kind").to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None, 0.5
    order = np.lexsort(x.T)  # sums do not depend on the order in which rows arrive
    x, kind = x[order], kind[order]
    prior = estimated_prior(x[kind == 1], x[kind == 0])
    return fit_risk(x[kind == 1], x[kind == 0], prior), prior


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = CUT
) -> DataFrame:
    """(id_col, held_out, score, predicted), one row per document."""
    import pyarrow as pa

    model, prior = fit(docs, labels, id_col, text_col, label_col)
    own = docs.select(docs[id_col], held_out(docs[id_col]).alias("held_out"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in chunks(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score = np.full(j - i, prior) if model is None else model.score(x)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
                )

    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
