"""Content addresses, search and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def object_id(kind: str, body: Column) -> Column:
    """sha1 of `kind length NUL body`, body as UTF-8 bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit(kind + " "), F.octet_length(body).cast("string")), "utf-8"), F.lit(bytearray(b"\0")), F.encode(body, "utf-8")))


def pkt_line(text: Column) -> Column:
    """Four hexadecimal digits of the length, themselves included, and the text."""
    return F.concat(F.lower(F.lpad(F.hex(F.octet_length(text).cast("long") + 4), 4, "0")), text)


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): lower-cased runs of ASCII letters and digits."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), 0)).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], k: int, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of a query (top-k is the feature). Only the query's terms are exploded."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    sized = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("n"), F.filter("w", lambda x: x.isin(query)).alias("hits"))
    totals = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    tf = sized.where(F.size("hits") > 0).select("id", "n", F.explode("hits").alias("term")).groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(totals))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return scored.groupBy("id").agg(F.round(F.sum(one), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, probe: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of largest cosine to a probe (top-k is the feature)."""
    score = cosine(F.col(vector_col).cast("array<double>"), F.array(*[F.lit(float(x)) for x in probe]))
    return vectors.select(F.col(id_col).alias("id"), F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def numbered(table: DataFrame, by: str, order: list[str]) -> DataFrame:
    return table.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
