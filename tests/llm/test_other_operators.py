"""URL filter, embedding dedup, SQL forms, and the pipeline against its stages done by hand."""

import glob
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import embedding_dedup, registry, url_filter

DATA = "/root/testdata/sf0.001"


def test_url_filter(spark):
    urls = ["http://A.Example.org/en/1x?q", "https://x.example.org/es/2", "http://example.com/fr/1", "http://a.com/de/#t", "http://org", "http://a.org/", "no scheme", None, "http://B.net", "http://quiet-lake.example.net/en/5",
            "ftp://spam-farm.example.net/en/3", "http://notexample.org/es/9", "http://u@h.com/fr/://x", "http://É.com/de/1", "://"]

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(t), t, v) for v, t in url_filter.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.url_filter(pages).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        host, path, rule, verdict = brute(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= url_filter.CUT else "allow"))
    by = {u: r.block_score for u, r in zip(urls, got, strict=True)}
    assert by["ftp://spam-farm.example.net/en/3"] > url_filter.CUT > by["http://quiet-lake.example.net/en/5"]
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_training_equals_numpy(spark):
    """The fold over the labelled table against the same steps in numpy, for the n-gram counts that Spark hashes."""
    weights = np.array(url_filter.train(spark, url_filter.LABELLED, buckets=64, epochs=2))
    rows = spark.createDataFrame([(i, y, h, p) for i, (y, h, p) in enumerate(url_filter.LABELLED)], "i int, y int, host string, path string")
    rows = rows.withColumn("at", url_filter.buckets_of(F.col("host"), F.col("path"), 64, url_filter.SIZES)).withColumn("h", F.xxhash64("i")).orderBy("h").collect()
    w = np.zeros(65)
    for _ in range(2):
        for r in rows:
            x = np.append(np.bincount(r["at"], minlength=64) / np.sqrt(len(r["at"])), 1.0)
            w = w * (1 - url_filter.RATE * url_filter.DECAY) + x * (r["y"] - 1 / (1 + np.exp(-(w @ x)))) * url_filter.RATE
    assert np.allclose(w, weights)


@pytest.mark.parametrize("tile", [4, 1024])
def test_embedding_dedup(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 24))
    rows = [(i, base[i % 30] * (1 + i % 3) + rng.normal(size=24) * [0, 0.05, 0.12, 0.5][i % 4], i % 2) for i in range(120)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows] + [(200, None, 0), (201, [], 0), (202, [0.0] * 24, 0), (203, [float("nan")] * 24, 0), (204, [1.0, None], 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0)]
    rows += [rows[4], rows[4], (207, rows[0][1], None), (None, rows[0][1], 0), (208, [1.0] * 23 + [float("inf")], 0)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, copies int, root int")
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    good = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                if np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98:
                    links[i].append(j)
    least = list(ids)
    for _ in rows:
        least = [min([least[i], *[least[j] for j in links[i]]]) for i in range(len(rows))]
    want = sorted((i, len(k), m, i == m) for i, k, m in zip(ids, links, least, strict=True))
    got = embedding_dedup.embedding_dedup(vectors, tile=tile).fillna(2**63 - 1, ["vec_id", "component_id"]).collect()
    assert sorted(tuple(r) for r in got) == want and any(w[1] for w in want)
    assert embedding_dedup.embedding_dedup(vectors.limit(0)).count() == 0


def test_embeddings_of_extreme_size_and_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1e-200, 2e-200]), (1, [2e-200, 4e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [5e-324, 1e-323]), (5, [2.0, -1.0]), (6, [1.7e308, 1.7e308])]
    for i in range(200):  # pairs whose cosine is 0.98 up to rounding
        a, b = rng.normal(size=(2, 16))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        rows += [(10 + 2 * i, a.tolist()), (11 + 2 * i, ((0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)) * rng.uniform(0.5, 3)).tolist())]
    vectors = spark.createDataFrame([(i, v, i // 2 if i > 9 else -1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(vectors).collect()}
    assert [got[i] for i in range(7)] == [(4, 0)] * 5 + [(0, 5), (0, 6)]
    held = dict(rows)
    for i in range(10, 410, 2):
        x, y = np.array(held[i]), np.array(held[i + 1])
        assert got[i][0] == (np.einsum("i,i", x, y) / (np.sqrt(np.einsum("i,i", x, x)) * np.sqrt(np.einsum("i,i", y, y))) >= 0.98)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_forms(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_follows_its_stages(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, DATA)
        frame.write.mode("overwrite").parquet(f"/tmp/basalt-test-{os.getpid()}/{i}")
        frame = spark.read.parquet(f"/tmp/basalt-test-{os.getpid()}/{i}")
        seen.append(frame)
        if i < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rules, unique, cut, mixed, packed = seen
    kept = {r.doc_id for r in registry.QUERIES["op2_quality_rules"](spark, DATA).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept
    assert {r.doc_id for r in unique.collect()} <= kept and unique.count() == unique.select("doc_id").distinct().count()
    first: dict = {}
    texts = {r.doc_id: r.text for r in unique.collect()}
    for i in sorted(texts):  # words that an earlier text's window of 50 covers are gone, by brute force
        ws = texts[i].split()
        for a in range(len(ws) - 49):
            first.setdefault(tuple(ws[a : a + 50]), i)
    for r in cut.collect():
        ws = texts[r.doc_id].split()
        gone = {j for a in range(len(ws) - 49) if first[tuple(ws[a : a + 50])] < r.doc_id for j in range(a, a + 50)}
        assert r.text == (" ".join(w for j, w in enumerate(ws) if j not in gone) if gone else texts[r.doc_id]) and r.n_chars == len(r.text)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in cut.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()} <= set(docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))
