import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag int, kept boolean, seed long, domain string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, blanks, copies, near copies, shared passages, repeated lines, a long text, repeated ids and clashing names."""
    rng = random.Random(5)
    passage = words(rng, 90, 5000)
    texts = [words(rng, rng.randrange(1, 300), 5000) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7] + " tail", passage, "x y " + passage + " z", words(rng, 60) + "\n" + passage, passage + " " + passage]
    texts += ["", "   \n\t ", None, "one", "é ü ñ " * 80, "a line that repeats itself often\n" * 30, words(rng, 6000, 50_000), "\x00" + words(rng, 70)]
    texts += [" ".join(w if i % 40 else "changed" for i, w in enumerate(texts[9].split()))]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 5}" if i % 7 else None, 1, 1, True, 1, "d") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (6, texts[11], "en", "src1", 1, 1, True, 1, "d"), (None, texts[3], "en", "src1", 1, 1, True, 1, "d"), (None, passage + " q", "de", None, 1, 1, True, 1, "d")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
