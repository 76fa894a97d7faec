"""Vectors against all pairs, notices against direct matching, quotes against a walk through each conversation."""

import random
import numpy as np
import pytest

from trialspark.llm import licenses as lc
from trialspark.llm import quotes as qu
from trialspark.llm import vector_dups as vd


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 16))
    x = np.vstack([base, base[:40] + 0.05 * rng.normal(size=(40, 16)), np.repeat(base[:1], 25, axis=0), base[1] + 0.1 * rng.normal(size=(60, 16))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] * 16), (904, [1.0, 2.0]), (905, []), (906, [None] + [1.0] * 15), (None, rows[3][1])]
    rows += [(907, [1e300] * 16), (908, [1e-300] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def brute(rows):
    """(links, root) of every id by all pairs of each length."""
    n, root = {}, {i: i for i, _ in rows}
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for length in {len(v) for _, v in usable}:
        good = [(i, v) for i, v in usable if len(v) == length]
        x = np.stack([v / np.abs(v).max() for _, v in good])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near, ids = x @ x.T >= vd.THRESHOLD - 1e-12, [i for i, _ in good]
        n.update(zip(ids, (near.sum(axis=1) - 1).tolist()))
        changed = True
        while changed:
            changed = False
            for a, b in zip(*np.nonzero(near)):
                m = min(root[ids[a]], root[ids[b]])
                if root[ids[a]] != m or root[ids[b]] != m:
                    root[ids[a]] = root[ids[b]] = m
                    changed = True
    return n, root


@pytest.mark.parametrize("shard", [1_500, 20])
def test_links(vectors, monkeypatch, shard):
    rows, df = vectors
    monkeypatch.setattr(vd, "SHARD", shard)
    n, root = brute(rows)
    got = vd.near_duplicates(df).collect()
    assert len(got) == len(rows)
    links = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= n.get(r["vec_id"], 0) for r in got)
    assert links >= 0.9 * sum(n.values())
    # whoever is in a component has a link
    assert all(r["n_links"] > 0 for r in got if r["vec_id"] is not None and not r["kept"])
    if shard == 1_500:
        assert links == sum(n.values())
        assert all(r["component_id"] == root[r["vec_id"]] for r in got if r["vec_id"] is not None)


def test_lengths_are_searched_apart(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [2.0, 4.01]), (7, [3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (1, 3), 5: (1, 3), 4: (0, 4), 7: (0, 7)}


def test_below_recall_parts_are_compared_in_full(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(vd, "search", lambda x, links, queries, *rest: np.zeros((len(queries), len(x)), bool))
    n, root = brute(rows)
    got = {r["vec_id"]: r for r in vd.near_duplicates(df).collect() if r["vec_id"] is not None}
    assert all(got[i]["n_links"] == n.get(i, 0) and got[i]["component_id"] == root[i] for i in got)


def test_clashing_columns_of_vectors(spark, vectors, helper_names):
    from pyspark.sql import functions as F

    rows, df = vectors
    wide = df.withColumns({c: F.lit("x") for c in [*helper_names, "rep", "n", "vec", "dim", "digest", "shard", "part", "role", "lane"]})
    assert sorted(map(str, vd.near_duplicates(wide).collect())) == sorted(map(str, vd.near_duplicates(df).collect()))


@pytest.mark.parametrize("m", [500, 2_000])
def test_dense_clusters_end(m):
    """One cluster in which all are near: a part's graph and search take time in proportion to its pairs."""
    import time

    rng = np.random.default_rng(m)
    x = vd.unit(list(np.ones(64) + 0.1 * rng.normal(size=(m, 64))))
    links = vd.build(x, 1)
    u, v = np.repeat(np.arange(m), links.shape[1]), links.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    start = time.perf_counter()
    lists = vd.united(x, u, v)
    assert lists.shape == (m, vd.UNITED)
    hits = 0
    for a in range(0, m, vd.QUERIES):
        hits += int(vd.search(x, lists, x[a : a + vd.QUERIES], [0], np.arange(m)[a : a + vd.QUERIES], vd.THRESHOLD).sum())
    assert hits >= 0.99 * int((x @ x.T >= vd.THRESHOLD).sum())
    assert time.perf_counter() - start < 20


def test_joined():
    rng = np.random.default_rng(2)
    hit = rng.random((12, 20)) < 0.06
    pairs = vd.joined(hit, np.arange(100, 112), np.arange(20))
    assert len(pairs) <= 32
    for edges in (pairs, [(100 + i, k) for i, k in zip(*np.nonzero(hit))]):
        root = {i: i for i in [*range(20), *range(100, 112)]}
        for _ in range(40):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        groups = sorted(root.items())
        first = groups if edges is pairs else first
    assert first == groups


def test_no_vectors(spark):
    assert vd.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vd.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == [(1, 0, 1, True)]


def test_repeated_vector_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])]
    assert {tuple(r) for r in vd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()} == {(1, 2, 1, True), (2, 2, 1, False)}


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy"


def test_notices():
    find = lc.Finder().find
    normal = b" ".join(lc.alnum_words(f"Some words. {NOTICE} and more".encode())).decode()
    (hit,) = find(normal)
    assert hit[0] == "mit" and hit[3] == 0 and normal[hit[1] : hit[2]].startswith("permission")
    (hit,) = find(normal.replace("hereby", "herby").replace("charge", "chrage"))
    assert hit[0] == "mit" and 2 <= hit[3] <= 3
    assert find("some words without any of them") == []


def test_every_notice_within_its_errors_is_found():
    import random

    rng, finder = random.Random(4), lc.Finder()
    for notice in finder.notices:
        for _ in range(5):
            chars = list(notice.text)
            for _ in range(notice.errors):
                chars[rng.randrange(len(chars))] = "#"
            found = finder.find("x y z " + "".join(chars) + " p q r")
            assert any(f[0] == notice.label for f in found)


def test_base_places(docs, spark, texts):
    more = {400: "CC-BY, cc by cc by. All rights reserved", 401: "the GNU General\nPublic, License", 402: "cc byte; accc by; all rights reserve"}
    df = docs.union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more.items()], docs.schema))
    for r in lc.scan(df).collect():
        text = (texts | more)[r["doc_id"]]
        words = [w.decode() for w in lc.alnum_words(text.encode() if text else None)]
        at = [(i, label) for p, label in lc.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_neighbouring_copies_are_all_found():
    """Copies side by side, exact and with edits in any order: each has its own span and edits."""
    finder = lc.Finder()
    for label, notice in lc.NOTICES[:4]:
        words = notice.split()
        edited = " ".join([*words[:2], words[2][:-1] + "#", *words[3:]])
        for copies in ([edited, notice], [notice, edited], [edited, edited, notice, edited], [notice] * 5):
            text = "before " + " ".join(copies) + " after"
            got = [g for g in finder.find(text) if g[4] == len(notice) and g[0] == label]
            assert [text[g[1] : g[2]].strip() for g in got] == copies
            assert [g[3] for g in got] == [edits_between(c, notice) for c in copies]


def test_labels_score_and_spans_by_brute_force(spark):
    """Every notice against every window of words, by edit distance."""
    rng = random.Random(12)
    texts = []
    for i in range(25):
        parts = [" ".join(rng.choice(["alpha", "beta", "the", "license", "software", "free"]) for _ in range(rng.randint(1, 12)))]
        for _ in range(rng.randint(0, 2)):
            label, notice = rng.choice(lc.NOTICES)
            chars = list(notice)
            for _ in range(rng.randint(0, max(1, len(notice) // lc.CHARS_PER_ERROR))):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            parts += ["".join(chars), " ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.randint(1, 6)))]
        texts.append(" ".join(parts))
    rows = {r["doc_id"]: r for r in lc.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words, labels, least = text.split(), set(), []
        for label, notice in lc.NOTICES:
            allowed, n = lc.Notice(label, notice).errors, len(notice.split())
            near = [edits_between(" ".join(words[a : a + k]), notice) for k in (n - 1, n, n + 1) for a in range(len(words) - k + 1)]
            if min(near, default=99) <= allowed:
                labels.add(label)
                least.append(1 - min(near) / len(notice))
        assert labels <= set(rows[i]["labels"].split(",")), (i, text)
        if least:
            assert rows[i]["score"] >= max(least) - 1e-9
        for span in rows[i]["spans"]:
            assert 0 <= span["first"] <= span["last"] < len(words)


def test_many_notices_take_linear_time(spark):
    import time

    finder, took = lc.Finder(), []
    for n in (500, 4_000):
        text = " ".join([lc.NOTICES[7][1] + " and"] * n)
        start = time.perf_counter()
        assert len([g for g in finder.find(text) if g[4] == len(lc.NOTICES[7][1])]) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * 3 * took[0] + 1
    row = lc.scan(spark.createDataFrame([(1, " ".join([lc.NOTICES[7][1] + " and"] * 10_000))], "doc_id long, text string")).first()
    assert [s["first"] for s in row["spans"] if s["label"] == "mit"] == [9 * i for i in range(10_000)]


def test_license_odd_tables(clashing, empty):
    assert lc.scan(clashing).count() == clashing.count()
    assert lc.scan(empty).count() == 0


TALK = [
    (1, 0, "user", "First question.\n\nSecond  part of it."),
    (1, 1, "assistant", "A wrote:\n> first QUESTION.\n\nAn answer."),
    (1, 2, "user", "> An answer.\n>> First question.\nThanks.\n> never said"),
    (1, 3, "user", "Unrelated."),
    (1, 4, "assistant", "> > first question.\nOnly nested."),
    (1, 5, "user", "> Unrelated.\nYes."),
    (1, 6, "user", None),
    (2, 0, "user", "> First question.\nOf another conversation."),
    (2, 0, "user", "> First question.\nOf another conversation."),
    (None, 1, "user", "> x"),
    (2, None, "user", "x"),
    (2, 70_000, "user", "> Of another conversation."),
    (2, 70_001, "user", ""),
]


def test_threads(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in qu.linked(df).collect()}
    assert qu.linked(df).count() == len(TALK)
    parents = {k: r["parent_turn"] for k, r in got.items()}
    assert parents == {
        (1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 0, (1, 5): 3, (1, 6): None, (2, 0): None, (None, 1): None, (2, None): None, (2, 70_000): 0, (2, 70_001): None,
    }
    threads = {k: r["thread_turn"] for k, r in got.items() if k[0] == 1}
    assert threads == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (1, 4): 0, (1, 5): 3, (1, 6): 6}
    assert got[1, 1]["text"] == "An answer." and got[1, 2]["text"] == "Thanks." and got[1, 6]["text"] == ""
    assert (got[1, 2]["n_quoted"], got[1, 2]["n_linked"]) == (3, 2)
    assert got[1, 4]["formatted"] == "<|assistant|>\nOnly nested.\n<|end|>\n"
    order = [(r["thread_turn"], r["turn"]) for r in qu.linked(df.where("conv_id = 1")).collect()]
    assert order == sorted(order)


def test_long_repeating_conversation(spark):
    rows = [(7, t, "user", "Again." if t % 3 else "> again.\nMore.") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for r in qu.linked(df).collect():
        t = r["turn"]
        assert r["parent_turn"] == (t - 1 if t and t % 3 == 0 else None)


def test_no_messages(spark):
    assert qu.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_trimmed_and_rewrapped_quotes(spark):
    """One line, one sentence, a start in mid-paragraph, other line breaks; a whole passage wins, then the most text."""
    first = "The mill stands by the old river.\nIt was built of grey stone and oak. Its\nwheel turned for a hundred years. Nobody\nlives there now."
    rows = {
        0: first,
        1: "The weather is fine. Nobody lives there now.",
        2: "> It was built of grey stone and oak. Its\n\nOne line.",
        3: "> Its wheel turned\n> for a hundred years.\n\nOne sentence, wrapped anew.",
        4: "> of grey stone and oak. Its wheel turned for a hundred\n> years. Nobody lives there now.\n\nFrom mid-paragraph.",
        5: "> Nothing of this was said.\n\nNo original.",
        6: "Its wheel turned for a hundred years.",
        7: "> Its wheel turned for a hundred years.\n\nA whole passage.",
        8: "> From mid-paragraph.\n>> Its wheel turned for a hundred\n>> years. Nobody said so.\n\nNested.",
        9: None,
    }
    df = spark.createDataFrame([(1, t, "user", x) for t, x in rows.items()] + [(2, 3, "user", rows[3])], "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in qu.linked(df).collect()}
    assert len(got) == 11
    assert {t: got[1, t]["parent_turn"] for t in rows} == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: None, 6: None, 7: 6, 8: 4, 9: None}
    assert got[2, 3]["parent_turn"] is None
    assert [got[1, t]["n_linked"] for t in (2, 3, 4, 5, 7, 8)] == [1, 1, 1, 0, 1, 2]
    assert {t: got[1, t]["thread_turn"] for t in (2, 3, 4, 8)} == {2: 0, 3: 0, 4: 0, 8: 0}
