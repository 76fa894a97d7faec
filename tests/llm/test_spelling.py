"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import DOCS

from trialspark.llm import spelling as sp


def edit_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, min_chars=7, min_count=2, ratio=10, every=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edit_apart(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def corpus(rng, docs=150):
    stems = ["".join(rng.choice("abcdeéÀÿz") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(1, 120)):
            w = stems[min(int(rng.expovariate(0.08)), 59)]
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(("", rng.choice("abcdeé"), rng.choice("abcdeé") + w[at])) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, "".join(w + rng.choice((" ", "-", "1", "\n", "日", "ß_")) for w in words)))
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = corpus(rng)
    out += [(500, None), (501, ""), (502, "  123 \t"), (None, "abcdefgh abcdefgh abcdefgi"), (503, "x" * 200_000 + " " + "x" * 200_000 + " " + "x" * 200_001 + " " + "x" * 200_001)]
    return out + out[:3]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts, tile", [(10, 1024), (2, 16), (1, 8), (26, 64)])
def test_against_all_pairs(spark, rows, parts, tile):
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 20 and max(w[4] for w in want) > 5
    assert found(sp.variants(frame(spark, rows), parts=parts, tile=tile)) == want


def test_other_limits_and_chains(spark, rows):
    want = brute(rows, 5, 1, 2, 3)
    assert any(w[1] != w[2] and w[1] is not None for w in want)  # forms of forms
    assert found(sp.variants(frame(spark, rows), min_chars=5, min_count=1, ratio=2, drop_every=3)) == want


def test_ties_take_the_smallest(spark):
    text = " ".join(["abcdefgx"] * 2 + ["abcdefga"] * 40 + ["abcdefgé"] * 40)
    rows = [(d, text) for d in range(1, 2)]
    got = {r["word"]: (r["form"], r["n_near"]) for r in sp.variants(frame(spark, rows), drop_every=1 << 33).collect()}
    assert got == {"abcdefgx": ("abcdefga", 2), "abcdefga": (None, 2), "abcdefgé": (None, 2)}


def test_empty_and_clashing(spark, empty, clashing):
    from pyspark.sql import functions as F

    assert sp.variants(empty).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    names = ("id", "block", "role", "n_near", "best", "best_n", "lo", "hi", "side", "cuts", "part", "other", "form", "top", "_next")
    assert found(sp.variants(clashing.withColumns({n: F.lit("x") for n in names}))) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=12, unique=True))
def test_one_edit_in_place(words):
    letters = sp.Letters([w.encode("latin-1") for w in words])
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(words)) for j in range(len(words)) if i != j and 0 <= len(words[i]) - len(words[j]) < 2] or [(0, 0)]))
    want = [edit_apart(words[i], words[j]) for i, j in zip(a, b)]
    if (a != b).all():
        assert sp.one_edit(letters, a, b).tolist() == want
