"""Shared lines against a dictionary of all lines, and the perfect hash by itself."""

import random

import numpy as np
import pytest
from llm_texts import DOCS, prose

from trialspark.llm import line_dedup as ld

BLANKS = " \t\n\v\f\r"


def brute(rows, min_chars, min_docs):
    """One (id, lines, dropped, kept) per row."""
    holders = {}

    def key(line):
        k = line.strip(BLANKS)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k) if len(k) >= min_chars else None

    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders.setdefault(key(line), set()).add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        shared = [h if h is not None and len(holders[h]) >= min_docs else None for h in map(key, lines)]
        kept = [x for x, h in zip(lines, shared) if h is None or max(holders[h]) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(11)
    common = [prose(rng, 6) for _ in range(25)] + ["This Page Was Printed At Home", "short", "é" * 19, "ü" * 20, "日本語テキスト" * 3]
    rows = []
    for i in range(300):
        lines = [rng.choice(common) if rng.random() < 0.4 else prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "  one line of a third of all documents\t")
        if i % 7 == 0:
            lines = [x.upper() + rng.choice(["", " ", "\r", "\v\t"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "   \t "), (404, "\n".join([common[0]] * 40)), (405, "\n".join(prose(rng, 3) for _ in range(5000)))]
    rows += [rows[0], rows[0], rows[5], (7, "another text of a known id, on a line of its own"), (None, common[0] + "\nno id here, none at all"), (None, common[1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(5)


@pytest.mark.parametrize("min_docs, min_chars", [(3, 20), (2, 5), (9, 20), (1, 20)])
def test_against_brute_force(spark, lined, min_docs, min_chars):
    got = ld.drop_shared_lines(frame(spark, lined), min_docs=min_docs, min_chars=min_chars, shard_bytes=20_000)
    assert found(got) == sorted(brute(lined, min_chars, min_docs), key=str)


def test_small_packs_give_the_same(spark, lined, monkeypatch):
    monkeypatch.setattr(ld, "PACK_LINES", 50)
    assert found(ld.drop_shared_lines(frame(spark, lined))) == sorted(brute(lined, 20, 3), key=str)


def test_two_documents_are_not_enough_and_repeats_are_one(spark):
    line = "a line that is long enough"
    rows = [(1, line), (2, line + "\n" + line), (2, line)]
    assert {r["n_dropped"] for r in ld.drop_shared_lines(frame(spark, rows)).collect()} == {0}
    got = {r["doc_id"]: r["n_dropped"] for r in ld.drop_shared_lines(frame(spark, [*rows[:2], (3, line)])).collect()}
    assert got == {1: 1, 2: 2, 3: 0}


def test_empty_and_clashing(spark, empty, clashing, lined):
    assert ld.drop_shared_lines(empty).collect() == []
    from pyspark.sql import functions as F

    names = ("id", "hashes", "pack", "shard", "kept", "n_lines", "n_dropped", "_key", "places")
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    got = ld.drop_shared_lines(clashing.withColumns({n: F.lit("x") for n in names}))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert found(got) == sorted(brute(rows, 20, 3), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_its_keys(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    h1[: n // 2] = h1[0] if n else 0  # only the second half tells these apart
    perfect = ld.PerfectHash.build(h1, h2)
    assert sorted(perfect(h1, h2)) == list(range(n))
    other = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    assert perfect(*other).max(initial=-1) < max(n, 1)


def test_index_rejects_lines_it_does_not_hold(spark, lined):
    packed = ld.packs(frame(spark, lined), "doc_id", "text", 3, 20, 3)
    other = ld.packs(frame(spark, [(1, "a line that no document holds\nand another such line")]), "doc_id", "text", 3, 20, 3)
    index = ld.build_index(packed, 3)
    assert ld.probe(other, index, 3).count() == 0
    assert ld.probe(packed, index, 3).count() > 0
