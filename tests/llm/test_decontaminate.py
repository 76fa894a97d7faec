"""Decontamination against a search of every window in every document."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import DOCS, prose

from trialspark.llm import decontaminate as dc
from trialspark.llm.common import alnum_words


def brute(words, items, window):
    hit, found = set(), set()
    for item, of in items:
        size = min(window, len(of))
        for k in range(len(of) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == of[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(item)
    return hit, found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), st.integers(1, 4))
def test_automaton_finds_every_window(items, words, window):
    named = [(str(i), of) for i, of in enumerate(items)]
    automaton = dc.SuffixAutomaton([(i, of, min(window, len(of))) for i, of in named if of], window)
    spans, found = automaton.match(words)
    hit, items_hit = brute(words, named, window)
    assert {k for a, b, _ in spans for k in range(a, b + 1)} == hit
    assert found == items_hit


def test_lengths_are_the_longest_matches():
    automaton = dc.SuffixAutomaton([("x", [b"a", b"b", b"c", b"d"], 2)], 2)
    assert automaton.match([b"z", b"b", b"c", b"d", b"z"])[0] == [(1, 3, 3)]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, n)) for i, n in enumerate((30, 15, 13, 5, 1))] + [(7, None), (8, ""), (None, prose(rng, 20))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def mixed(spark, docs, items, texts):
    held = [r["text"] for r in items.collect() if r["text"]]
    rng = random.Random(3)
    rows = [(200 + 2 * i + (n > 3), " ".join([prose(rng, n), t, prose(rng, n)]), "en", "s", 1) for i, t in enumerate(held) for n in (3, 400)]
    part = held[0].split()
    rows += [(300, " ".join(part[4:18]), "en", "s", 1), (301, " ".join(part[4:16]), "en", "s", 1), (302, held[0].upper().replace(" ", "\n-- "), "en", "s", 1)]
    return docs.union(spark.createDataFrame(rows, DOCS))


def test_against_brute_force(mixed, items):
    held = [(str(r["item_id"]) if r["item_id"] is not None else None, alnum_words(r["text"].encode() if r["text"] else None)) for r in items.collect()]
    got = {r["doc_id"]: r for r in dc.contamination(mixed.where("doc_id <> 86"), items).collect()}
    for doc in mixed.where("doc_id <> 86").collect():
        words = alnum_words(doc["text"].encode() if doc["text"] else None)
        hit, found = brute(words, held, 13)
        row = got[doc["doc_id"]]
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (len(words), len(hit), len(found - {None})), doc["doc_id"]
        assert row["contaminated"] == (bool(hit) and 20 * len(hit) >= len(words))


def test_clean_keeps_columns_and_cuts_spans(mixed, items):
    got = {r["doc_id"]: r for r in dc.decontaminate(mixed, items).collect()}
    rows = {r["doc_id"]: r for r in dc.contamination(mixed, items).collect()}
    assert set(got) == {i for i, r in rows.items() if not r["contaminated"]}
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    for doc in mixed.collect():
        row = rows[doc["doc_id"]]
        if not row["n_hit"] and doc["doc_id"] in got:
            assert got[doc["doc_id"]] == doc
        elif doc["doc_id"] in got:
            kept = word.findall(got[doc["doc_id"]]["text"].encode())
            assert len(kept) == row["n_words"] - row["n_hit"] and got[doc["doc_id"]]["n_chars"] == len(got[doc["doc_id"]]["text"])


def test_shards_and_long_items(mixed, items, monkeypatch):
    whole = sorted(dc.contamination(mixed, items).collect())
    monkeypatch.setattr(dc, "SHARD_WORDS", 20)
    assert [r[:6] for r in sorted(dc.contamination(mixed, items).collect())] == [r[:6] for r in whole]


def test_odd_tables(clashing, empty, items):
    assert dc.contamination(clashing, items).count() == clashing.count()
    assert dc.decontaminate(clashing, items).columns == clashing.columns
    assert dc.contamination(empty, items).count() == 0
    nothing = dc.contamination(clashing, items.limit(0))
    assert nothing.where("n_hit > 0 OR contaminated").count() == 0
