import random

import pytest
from llm_texts import DOCS, prose

from trialspark.llm.common import ship

@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, and the odd cases: null, empty, blanks, no letters, long, repeated."""
    rng = random.Random(5)
    out = {}
    for i in range(60):
        out[i] = prose(rng, rng.randint(20, 160), "en" if i % 3 else "fr")
    for i in range(60, 80):  # copies and near copies of a few texts
        words = out[i % 4].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        out[i] = " ".join(words)
    out |= {80: None, 81: "", 82: "   \n\t ", 83: "123 456 %%% ||", 84: "one", 85: "two words", 86: prose(rng, 20_000)}
    out |= {87: "Ünïcode wörds — 日本語 テキスト", 88: "same same same same same same", 89: "one"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if i % 11 == 0 else "en" if i % 3 else "fr", f"src{i % 3}", len(t) if t is not None else None) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """Extra columns named as operators name theirs, a null id, a repeated row."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(None, "text without an id", "en", "src0", 18), (5, "text of a repeated id", "en", "src0", 21)], DOCS)
    both = docs.union(more).union(docs.where("doc_id IN (3, 80)"))
    extra = {c: F.lit("x") for c in ("digest", "sig", "rep", "root", "key", "bucket", "n", "word", "lane", "score", "uid", "length", "blob_id", "rule")}
    return both.withColumns(extra)


@pytest.fixture(scope="session")
def helper_names():
    """Every underscored column name that the subpackage writes, and some with more underscores."""
    import pathlib
    import re

    import trialspark.llm

    found = set()
    for path in pathlib.Path(trialspark.llm.__file__).parent.glob("*.py"):
        found |= set(re.findall(r"""["'`(, ](_[a-z][a-z_0-9]*)\b""", path.read_text()))
    return sorted(n for n in found | {"_spans_", "_lang_", "_cuts_"} if not n.startswith("__"))
