"""The learned operators' parts against plain loops: risk and gradient, class prior, n-gram sets and predictions."""

import math
import random
from collections import Counter

import numpy as np

from basalt.llm import language_id, quality_classifier


def test_risk_gradient_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    for prior, shift in ((0.4, 0.3), (0.9, 2.5)):  # the second has a negative second term
        p, u = rng.normal(shift, 1, (13, 4)), rng.normal(0, 1, (17, 4))
        w = rng.normal(size=4) if shift < 1 else np.full(4, 2.0)
        loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
        second = lambda w: sum(loss(-sum(a * b for a, b in zip(x, w))) for x in u) / 17 - prior * sum(loss(-sum(a * b for a, b in zip(x, w))) for x in p) / 13
        first = lambda w: prior * sum(loss(sum(a * b for a, b in zip(x, w))) for x in p) / 13
        risk = (lambda w: first(w) + second(w)) if second(w) >= 0 else (lambda w: -second(w))
        want = [(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(4) * 1e-5]
        assert np.allclose(quality_classifier.risk_gradient(w, p, u, prior), want, atol=1e-4)


def test_class_prior_is_found_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    draw = lambda n, good: rng.normal(1.5 if good else -1.5, 1, (n, 3))
    for prior in (0.3, 0.6, 0.85):
        unlabelled = np.concatenate([draw(int(4000 * prior), True), draw(4000 - int(4000 * prior), False)])
        rng.shuffle(unlabelled)
        assert abs(quality_classifier.estimated_prior(draw(3000, True), unlabelled) - prior) < 0.06


def brute_grams(text):
    """n-grams of lower-cased letters, words framed by single blanks, blanks at the ends only."""
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    framed = " " + " ".join(low.split()) + " " if low.split() else ""
    return {n: [framed[i : i + n] for i in range(len(framed) - n + 1) if " " not in framed[i + 1 : i + n - 1]] for n in language_id.SIZES}


def test_language_masks_and_predictions_against_exact_sets(spark):
    rng = random.Random(6)
    pools = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for lang, letters in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}.items()}
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(40)), lang) for i, lang in enumerate(rng.choices(sorted(pools), k=240))]
    rows += [(1000, "zzyzx qqq wvw", "rare")]  # a language of a single document is learned as well
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["aa", "bb", "cc", "rare"]
    learned = {r.doc_id for r in docs.where(~language_id.held_out(docs.doc_id)).collect()}
    in_docs = {lang: Counter(g for i, t, l in rows if l == lang and i in learned for g in {g for gs in brute_grams(t).values() for g in gs}) for lang in model.languages}
    n_docs = {lang: sum(l == lang and i in learned for i, _, l in rows) for lang in model.languages}
    rate = lambda l, g: in_docs[l][g] / (n_docs[l] + language_id.SHRINK)
    least = {l: 1 + sum(n_docs[l] >= n for n in language_id.LEAST_AT) for l in model.languages}
    exact = {l: {g for g in in_docs[l] if in_docs[l][g] >= least[l] and rate(l, g) >= language_id.RELATIVE * max(rate(k, g) for k in model.languages if in_docs[k][g] >= least[k])} for l in model.languages}
    everything = sorted({g for gs in in_docs.values() for g in gs})
    hashes = []
    for g in everything:  # an n-gram's own hash: the one that only its length and letters give
        got, _, _ = language_id.gram_hashes([g.strip()], (len(g),))
        hashes.append(got[brute_grams(g)[len(g)].index(g)])
    at = np.array(hashes, np.uint64)
    masks = np.bitwise_and.reduce([model.slots[model.at(at, k, len(model.slots)), 0] for k in range(language_id.HASHES)])
    false = total = 0
    for l, lang in enumerate(model.languages):
        bit = (masks >> np.uint64(l)) & np.uint64(1)
        member = np.array([g in exact[lang] for g in everything])
        assert bit[member].all()  # a Bloom filter forgets nothing
        false, total = false + int(bit[~member].sum()), total + int((~member).sum())
    assert false <= max(3, 0.01 * total)
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs, model=model).collect()}
    for i, t, _ in rows:
        hits = {lang: sum(g in exact[lang] for gs in brute_grams(t).values() for g in gs) for lang in model.languages}
        best = max(hits.values())
        if sorted(hits.values())[-2] < best - 3:
            assert got[i] == max(hits, key=hits.get)


def test_long_and_repeated_rows(spark):
    long = "the school and the house " * 60_000
    docs = spark.createDataFrame([(1, long, "en"), (1, "the house", "en"), (2, "die schule", "de"), (3, None, None), (3, "", None), *[(4, "das haus", "de")] * 40], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int")
    assert language_id.language_id(docs).count() == quality_classifier.quality_scores(docs, labels).where("score between 0 and 1").count() == 45
