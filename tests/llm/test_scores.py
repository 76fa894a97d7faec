"""Language identification and quality scores."""

from collections import Counter

import numpy as np
import pytest
from llm_texts import prose

from trialspark.llm import language as la
from trialspark.llm import quality
from trialspark.llm.common import remainder


def slow_grams(text):
    words, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    return out


def code(gram):
    out = 0
    for ch in gram:
        out = out << 21 | ord(ch)
    return out


def test_grams(texts):
    for text in [t for i, t in texts.items() if t and i != 86]:
        codes, n = la.counted(la.gram_codes(text))
        assert dict(zip(codes.tolist(), n.tolist())) == {code(g): k for g, k in slow_grams(text).items()}


def test_profiles_and_distance(docs, texts):
    model = la.learn(docs)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").collect()
    ranks = {}
    for lang in ("en", "fr"):
        total = Counter()
        for r in rows:
            if r["lang"] == lang:
                total.update(slow_grams(r["text"]))
        order = sorted(total, key=lambda g: (-total[g], code(g)))[: la.PROFILE]
        ranks[lang] = {g: i for i, g in enumerate(order)}
    for r in la.predict(docs, model).collect():
        counts = slow_grams(r["text"] or "")
        if not counts:
            assert (r["_lang"], r["_score"]) == (la.UND, 0.0)
            continue
        top = sorted(counts, key=lambda g: (-counts[g], code(g)))[: la.PROFILE]
        d = {lang: sum(abs(i - of[g]) if g in of else la.PROFILE for i, g in enumerate(top)) for lang, of in ranks.items()}
        best = min(d, key=lambda lang: (d[lang], lang))
        assert r["_lang"] == best
        far = la.PROFILE * len(top)
        assert r["_score"] == pytest.approx(0.0 if d[best] == far else max(d.values()) / sum(d.values()) if sum(d.values()) else 0.5)


def test_language_odd_tables(clashing, empty, docs):
    model = la.learn(docs)
    assert la.predict(clashing, model).count() == clashing.count()
    kept = la.accepted(clashing, model)
    assert kept.columns == clashing.columns and kept.where("doc_id IN (80, 81, 83)").count() == 0
    assert la.predict(docs, la.learn(empty)).where("_lang <> 'und'").count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = prose(rng, 60) if good else " | ".join(prose(rng, 1) for _ in range(40))
        rows.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_of_held_out_rows(graded):
    docs, labels = graded
    out = quality.score(docs, labels, remainder("doc_id", 5) == 0, remainder("doc_id", 5) == 1).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).collect()
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_isotonic():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 5, 40)
    p = rng.binomial(n, 0.5)
    got = quality.isotonic(p, n)
    assert (np.diff(got) >= -1e-12).all()
    some = n > 0  # the pooled fit keeps the total
    assert (got[some] * n[some]).sum() == pytest.approx(p.sum())


def test_fourier_features_approximate_the_kernel():
    f = quality.Fourier(np.zeros(3), np.ones(3), 20_000, 0.1)
    x = np.random.default_rng(0).normal(size=(6, 3))
    z = f(x)[:, :-1]
    assert np.abs(z @ z.T - np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))).max() < 0.05


def test_sums_in_a_tree(spark):
    parts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "pid long, v array<double>")
    assert quality.summed(parts).tolist() == [4950.0, 100.0]


def test_quality_odd_tables(spark, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, None), (5, 7), (None, 1), (10_000, 1)], "doc_id long, quality int")
    held, fold = remainder("doc_id", 5) == 0, remainder("doc_id", 5) == 1
    out = quality.score(clashing, labels, held, fold)
    assert out.count() == clashing.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(clashing, labels.limit(0), held, fold).where("score <> 0.5").count() == 0
    assert quality.score(empty, labels, held, fold).count() == 0
