"""Byte contexts over whole texts against the definition."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from trialspark.llm import ppm
from trialspark.llm.common import LOWER, remainder


def slow_stream(texts, train, order):
    """Code length of each text by a trie over documents: method D, exclusion of bytes seen in longer contexts."""
    trie = {}

    def steps(text):
        line = [ppm._START] * order + list(text) + [ppm._END]
        return [(tuple(line[i - order : i]), line[i]) for i in range(order, len(line))]

    for i in train:
        for context, byte in steps(texts[i]):
            for k in range(order + 1):
                trie.setdefault(context[order - k :], Counter())[byte] += 1
    cache, out = {}, {}
    for i, text in texts.items():
        out[i] = 0.0
        for step in steps(text):
            if step not in cache:
                (context, byte), total, excluded = step, 0.0, set()
                for k in range(order, -1, -1):
                    node = trie.get(context[order - k :])
                    if node is None:
                        continue
                    left = {b: n for b, n in node.items() if b not in excluded}
                    weight = sum(left.values())
                    if byte in left:
                        total += log10((left[byte] - 0.5) / weight)
                        break
                    if left:
                        total += log10(len(left) / 2 / weight)
                    excluded |= set(node)
                else:
                    total -= log10(ppm._SYMBOLS - len(excluded))
                cache[step] = total
            out[i] += cache[step]
    return out


@pytest.mark.parametrize("order, pack, shard", [(3, 4_000, 2_000), (6, 9_000, 5_000), (4, ppm.PACK_BYTES, ppm.SHARD_BYTES)])
def test_scores(docs, texts, monkeypatch, order, pack, shard):
    monkeypatch.setattr(ppm, "PACK_BYTES", pack)
    monkeypatch.setattr(ppm, "SHARD_BYTES", shard)
    monkeypatch.setattr(ppm, "PART_BYTES", pack // 3)
    low = {i: (t or "").encode().translate(LOWER) for i, t in texts.items() if i != 86}
    train = {i for i in low if zlib.crc32(str(i).encode()) % 10}
    tokens = Counter(w for i in train for w in low[i].split() + [None])
    lp, total, distinct = slow_stream(low, train, order), sum(tokens.values()), len(tokens)
    got = ppm.score(docs.where("doc_id <> 86"), remainder("doc_id", 10) == 0, order=order).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(low)
    for r in got:
        words = low[r["doc_id"]].split() + [None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(tokens[w] > 0 for w in words), total)
        assert r["held_out"] == (r["doc_id"] not in train)
        assert r["base_score"] == pytest.approx(sum(log10((tokens[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words))
        assert r["score"] == pytest.approx(lp[r["doc_id"]])


def test_word_order_matters(spark, tmp_path):
    from trialspark.llm.queries import QUERIES

    text = "the old house stands near the river and the mill"
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, text) for i in range(1000, 1030)] + [(ids[0], text), (ids[1], " ".join(reversed(text.split())))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op2_ppm_score"](spark, str(tmp_path)).collect()}
    assert got[ids[0]]["base_score"] == pytest.approx(got[ids[1]]["base_score"])
    assert got[ids[0]]["score"] > got[ids[1]]["score"] + 5


def test_held_out_total_is_above_the_base(spark):
    """The model, which also pays for blanks and spells unknown words, is better than word frequencies."""
    import os

    from trialspark.llm.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("test tables not present")
    got = QUERIES["op2_ppm_score"](spark, "/root/testdata/sf0.01").groupBy("held_out").sum("score", "base_score").collect()
    for r in got:
        assert r["sum(score)"] > r["sum(base_score)"]


def test_probabilities_add_up_to_one():
    texts = [b"abcabd", b"ab", b"", b"bcd", b"abca"]
    order = 3
    seen, n = ppm.pack_grams(texts, [False] * len(texts), order)
    low = ppm.low_levels(*ppm.summed(ppm.shorter(seen, 1), n))
    contexts = np.unique(np.concatenate([seen >> 8, [0x616263, 0x010101, 0x7A6261]]))
    asked = np.sort((contexts[:, None] << 8 | np.array([b for b in range(256) if b not in (0xFE, 0xFD)])).ravel())
    counts = np.zeros(len(asked), np.int64)
    counts[np.searchsorted(asked, seen)] = n
    p = 10 ** ppm.log_probabilities(asked, counts, low, order)
    for context in contexts:
        assert p[(asked >> 8) == context].sum() == pytest.approx(1)


def test_squeezed():
    rng = np.random.default_rng(1)
    for x in (np.sort(rng.integers(0, 1 << 56, 1000)), np.zeros(0, np.int64), np.array([5])):
        assert (ppm.unsqueezed(ppm.squeezed(x, True), True) == x).all() and (ppm.unsqueezed(ppm.squeezed(x)) == x).all()


def test_odd_tables(spark, clashing, empty):
    rows = ppm.score(clashing, remainder("doc_id", 10) == 0).collect()
    assert len(rows) == clashing.count() and all(r["score"] < 0 for r in rows)
    assert ppm.score(empty, remainder("doc_id", 10) == 0).count() == 0
    none = ppm.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), remainder("doc_id", 1) == 0).first()
    assert none["score"] == pytest.approx(-3 * log10(ppm._SYMBOLS)) and none["n_known"] == 0
