"""The stages in a row, and all registered queries."""

import pytest
from test_near_dups import brute

import corpus_pipeline as cp


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "secret_scan", "sequence_packing"]


def test_stages(spark, docs, texts, tmp_path):
    from trialspark.llm.common import save

    item = " ".join(texts[5].split()[:15])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    secret = spark.createDataFrame([(500, texts[7] + " changed a lot of it here and token=abcdefgh there " + texts[8], "en", "s", 1)], docs.schema)
    at, seen = docs.union(secret), []
    for name, stage in cp.STAGES[:-1]:
        at = save(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in at.collect()})
    whole = texts | {500: secret.first()["text"]}
    assert set(whole) - set(seen[0]) == {80, 81, 82, 83}
    _, root = brute({i: t for i, t in whole.items() if i in seen[0]}, 5, (80, 100))
    assert set(seen[1]) == {i for i, r in root.items() if i == r}
    assert 5 not in seen[2] or len(texts[5].split()) > 20 * 15
    assert "<secret>" in seen[3][500] and "token=" not in seen[3][500]
    packed = cp.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen[3])


@pytest.mark.parametrize("name", [f"op{i}_" for i in range(1, 14)] + ["pipeline"])
def test_registered(name):
    import __spark_entry__ as entry

    assert any(q.startswith(name) for q in entry.queries())


def test_stages_with_clashing_columns(spark, docs, helper_names, tmp_path):
    """Columns called as any helper column is leave every stage as they came, and change no decision."""
    from pyspark.sql import functions as F

    from trialspark.llm.common import save

    item = " ".join(docs.where("doc_id = 5").first()["text"].split()[:15])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    secret = docs.where("doc_id = 7").selectExpr("500L AS doc_id", "concat('some other words token=abcdefgh ', reverse(text)) AS text", "lang", "source", "n_chars")
    plain = docs.union(secret)
    assert {"_spans", "_lang", "_score", "_cuts", "_blob", "_new", "_blob_id", "_dropped"} <= set(helper_names)
    wide = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in helper_names})
    for name, stage in cp.STAGES[:-1]:
        plain, wide = (save(stage(spark, at, str(tmp_path)), name) for at in (plain, wide))
        assert wide.columns == [*plain.columns, *helper_names]
        assert sorted(map(tuple, wide.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        assert all(r[n] == f"{n}{r['doc_id']}" for r in wide.collect() for n in helper_names)
    a, b = (cp.STAGES[-1][1](spark, at, str(tmp_path)) for at in (plain, wide))
    assert a.columns == b.columns and a.count() == b.count() > 0
