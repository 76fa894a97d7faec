"""Packing: ids against the tokenizers library, whole round trip, few sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trialspark.llm import packing as pk


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [pk.END_ID]


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_ids_are_those_of_tokenizers(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_are_those_of_tokenizers, "t") else test_ids_are_those_of_tokenizers.t
    test_ids_are_those_of_tokenizers.t = t
    assert pk.encoder(pk.tokenizer_path())(text) == t.encode(text, add_special_tokens=False).ids


def check(rows, texts, reference, length):
    by_doc, places = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = reference(text)
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine[:-1]]))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == length for r in mine[1:])
        assert len(mine) == -(-len(ids) // length)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            if "ids" in r:
                assert r["ids"] == part
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in rows)
    return len(places), -(-total // length)


@pytest.mark.parametrize("length", [64, 1024])
def test_round_trip(docs, texts, reference, length):
    rows = pk.pack(docs, length=length, with_ids=True).collect()
    packed, least = check([r.asDict() for r in rows], texts, reference, length)
    assert packed <= least * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 48), min_size=1, max_size=300))
def test_plan_places_every_piece(lengths):
    h = np.bincount(lengths, minlength=49)
    plan = pk.Plan(h, 48)
    n = np.repeat(np.arange(49), h)
    rank = np.concatenate([np.arange(k) for k in h])
    sequence, offset = plan.place(n, rank)
    used = {}
    for s, o, k in sorted(zip(sequence.tolist(), offset.tolist(), n.tolist())):
        assert used.get(s, 0) == o
        used[s] = o + k
    assert max(used.values()) <= 48 and len(used) == plan.sequences


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    h = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    least = -(-int(h @ np.arange(1025)) // 1024)
    assert pk.Plan(h).sequences <= 1.01 * least


def test_lanes_of_a_common_length(docs, texts, reference, monkeypatch):
    from trialspark.llm import common

    monkeypatch.setattr(pk, "rank_rows", lambda *a: common.rank_rows(*a, per_task=5))
    check([r.asDict() for r in pk.pack(docs, length=64).collect()], texts, reference, 64)


def test_odd_tables(clashing, empty):
    assert pk.pack(clashing).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()
    assert pk.pack(empty).count() == 0


@pytest.fixture(scope="module")
def by_default():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "é"]), st.text(max_size=5)), max_size=12).map("".join))
def test_ids_with_added_tokens(by_default, text):
    assert pk.encoder(pk.tokenizer_path())(text) == by_default.encode(text, add_special_tokens=False).ids


def test_pieces_with_added_tokens(spark, by_default):
    assert pk.ADDED == {t.content: i for i, t in by_default.get_added_tokens_decoder().items()}
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>" * 100, 3: "x<|endoftext|", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [r.asDict() for r in pk.pack(df, length=64, with_ids=True).collect()]
    check(rows, texts, lambda text: by_default.encode(text or "", add_special_tokens=False).ids + [pk.END_ID], 64)


@pytest.mark.parametrize("run", [" " * 2_000_000 + "x", "\n" * 2_000_000, "a" * 2_000_000, "\t \n" * 700_000 + "é", "x " * 300_000 + " " * 1_500_000])
def test_long_runs(spark, reference, run):
    got = pk.pieces(spark.createDataFrame([(1, run)], "doc_id long, text string"), "doc_id", "text", with_ids=True).orderBy("piece").collect()
    ids = [i for r in got for i in r["ids"]]
    assert ids == reference(run)
