"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pytest
from llm_texts import DOCS, prose

from trialspark.llm import near_dups as nd
from trialspark.llm.common import space_words
from trialspark.llm.components import components


def shingles(text, size):
    words = space_words(text.encode() if text else None)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(texts, size, threshold):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    ids = [i for i in sets if sets[i]]
    edges = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if threshold[1] * common >= threshold[0] * (len(sets[a]) + len(sets[b]) - common):
                edges.append((a, b))
    return sets, roots(sets, edges)


@pytest.fixture(scope="module")
def family(spark, docs, texts):
    """A chain of texts that drift apart, so that only neighbours are near."""
    rng = random.Random(8)
    words = prose(rng, 150).split()
    rows = {}
    for i in range(100, 130):
        rows[i] = " ".join(words)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"w{rng.random():.3f}"
    df = docs.union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], DOCS))
    return df, texts | rows


@pytest.mark.parametrize("size, threshold", [(3, (85, 100)), (5, (80, 100))])
def test_against_all_pairs(family, size, threshold):
    df, texts = family
    sets, root = brute(texts, size, threshold)
    for row in nd.near_duplicates(df, size=size, threshold=threshold).collect():
        i = row["doc_id"]
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[i]), root[i], root[i] == i), i


def test_blocks_of_one_bucket(family, monkeypatch):
    df, texts = family
    whole = sorted(nd.near_duplicates(df).collect())
    monkeypatch.setattr(nd, "BLOCK", 2)
    assert sorted(nd.near_duplicates(df).collect()) == whole


def test_signatures_estimate_similarity():
    a, b = nd.hash_family(2_000)
    x, y = (nd.shingle_set(" ".join(map(str, r)).encode(), 1, {}) for r in (range(300), range(100, 400)))
    assert abs((nd.signature(x, a, b) == nd.signature(y, a, b)).mean() - 0.5) < 0.05


def test_bands_reach_the_threshold():
    for threshold in ((85, 100), (80, 100)):
        missed = (1 - (threshold[0] / threshold[1]) ** nd.ROWS) ** nd.bands_for(threshold)
        assert missed <= nd.MISS


def test_odd_tables(clashing, empty):
    out = nd.near_duplicates(clashing)
    assert out.count() == clashing.count()
    assert out.where("doc_id IS NULL AND component_id IS NULL AND kept").count() == 1
    assert nd.near_duplicates(empty).count() == 0
    kept = nd.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id = 80").count() == 2


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
