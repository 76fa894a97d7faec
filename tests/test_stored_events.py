"""Stored event tables: equal results, no movement of event rows, checked keys, hot trials apart."""

import os
import random

import pytest

from trialspark.operators import asof, attach, classify, markers
from trialspark.operators.attach import TRIAL
from trialspark.operators.parted import Parted, together
from trialspark.plans import gaze, saccades
from trialspark.sources import event_tables as tables
from trialspark.sources import stored_events as se
from trialspark.sources.trial_logs import EVENT_KEY

DIRECTORY = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables not present")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def events(spark):
    return {"fixations": tables.load_fixations(spark, DIRECTORY), "saccades": tables.load_saccades(spark, DIRECTORY)}


@pytest.fixture(scope="module", params=[None, 60])
def store(request, spark, events, tmp_path_factory):
    """Without heavy trials, and with those of more than 60 events apart."""
    folder = str(tmp_path_factory.mktemp("store") / "events")
    return se.store_events(events, folder, 8, {"fixations": EVENT_KEY}, split_rows=request.param)


ANALYSES = {
    "markers": lambda fx, sc: gaze.markers_of(fx),
    "phases": lambda fx, sc: gaze.phase_prop(fx),
    "labels": lambda fx, sc: gaze.distractor_duration_cells(fx),
    "durations": lambda fx, sc: gaze.target_duration(fx),
    "refixation": lambda fx, sc: gaze.refixation_cells(fx),
    "objects": lambda fx, sc: gaze.first_object_share(fx),
    "regions": lambda fx, sc: gaze.target_region_cells(fx),
    "leading": lambda fx, sc: saccades.leading_saccades(sc, gaze.markers_of(fx)),
    "first search": lambda fx, sc: saccades.with_first_search(sc, gaze.markers_of(fx)),
    "latency": lambda fx, sc: saccades.latency_all(sc, gaze.markers_of(fx)),
}


def rounded(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in together(df).collect())


@needs_tables
@pytest.mark.parametrize("name", ANALYSES)
def test_same_results(events, store, name):
    fn = ANALYSES[name]
    want = rounded(fn(events["fixations"], events["saccades"]))
    assert len(want) > 0 and rounded(fn(store["fixations"], store["saccades"])) == want


@needs_tables
def test_heavy_trials_are_apart(events, store):
    counts = {(r["participant"], r["tno"]): r["n"] for r in attach.row_counts(events["fixations"], name="n").collect()}
    heavy = {k for k, n in counts.items() if n > 60}
    fx = store["fixations"]
    if fx.heavy is None:
        return
    assert heavy and {(r["participant"], r["tno"]) for r in fx.heavy.select(*TRIAL).distinct().collect()} == heavy
    assert not heavy & {(r["participant"], r["tno"]) for r in fx.usual.select(*TRIAL).distinct().collect()}


@needs_tables
def test_no_exchange_below_the_cells(spark, events, tmp_path, sorted_joins):
    """Markers, labels and as-of rows of bucketed events come without any shuffle."""
    store = se.store_events(events, str(tmp_path / "s"), 8, {"fixations": EVENT_KEY})
    fx, sc = store["fixations"], store["saccades"]
    marks = gaze.markers_of(fx)
    for rows in (marks, gaze.distractor_phases(classify.classify(fx), marks), saccades.leading_saccades(sc, marks)):
        assert isinstance(rows, Parted) and "Exchange" not in plan(rows.usual)
    text = plan(gaze.phase_prop(fx))
    for exchange in [x for x in text.splitlines() if "Exchange" in x]:
        assert "tno" not in exchange  # only cells of participants move


@needs_tables
def test_open_in_another_session(spark, store):
    other = spark.newSession()
    again = se.open_events(other, store["fixations"].store)
    assert rounded(gaze.markers_of(again["fixations"])) == rounded(gaze.markers_of(store["fixations"]))


def fixture(spark, rows):
    return spark.createDataFrame(rows, "participant string, tno int, fix_count int, start_time double")


def test_a_hot_trial_is_spread(spark, tmp_path):
    rows = [("p", 0, i, float(i)) for i in range(4000)] + [("p", 1 + i % 50, i, 0.0) for i in range(1000)]
    df = fixture(spark, rows).repartition(8)
    store = se.store_events({"e": df}, str(tmp_path / "s"), 8, {"e": EVENT_KEY}, split_rows=1000)["e"]
    sizes = [r["count"] for r in store.heavy.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
    side = store.groupBy(*TRIAL).agg(*attach.aggregates({"n": "count(1)", "v": "max(fix_count)"}))
    out = together(attach.attach(store, side, "n"))
    want = {t: max(i for _, k, i, _ in rows if k == t) for t in range(51)}
    got = out.collect()
    assert len(got) == 5000 and all(r["v"] == want[r["tno"]] for r in got)


@pytest.mark.parametrize("split", [None, 3])
@pytest.mark.parametrize("bad, problem", [(("p", 1, 2, 0.0), "repeated"), (("p", None, 9, 0.0), "missing"), (("p", 1, None, 0.0), "missing"), ((None, 1, 1, 0.0), "missing")])
def test_keys_are_checked_while_writing(spark, tmp_path, split, bad, problem):
    good = [("p", 1, i, 0.1) for i in range(5)] + [("q", 2, 1, 0.1)]
    assert se.store_events({"e": fixture(spark, good)}, str(tmp_path / "a"), 2, {"e": EVENT_KEY}, split_rows=split)["e"].count() == 6
    with pytest.raises(Exception, match=problem):
        se.store_events({"e": fixture(spark, [*good, bad])}, str(tmp_path / "b"), 2, {"e": EVENT_KEY}, split_rows=split)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        se.open_events(spark, str(tmp_path / "b"))  # not finished


def test_empty_store_and_types(spark, tmp_path):
    store = se.store_events({"e": fixture(spark, [])}, str(tmp_path / "s"), 2, {"e": EVENT_KEY})["e"]
    assert store.count() == 0 and store.heavy is None
    other = spark.createDataFrame([], "participant string, tno long")
    with pytest.raises(ValueError, match="types"):
        se.store_events({"e": fixture(spark, []), "o": other}, str(tmp_path / "t"), 2)


@pytest.mark.parametrize("split", [None, 4])
def test_asof_with_ties(spark, tmp_path, split):
    rnd = random.Random(3)
    sacc = spark.createDataFrame([("p", rnd.randrange(6), rnd.randrange(9) / 2, i) for i in range(200)], "participant string, tno int, t double, i int")
    pts = spark.createDataFrame([("p", t, 7, 2.5 + t / 3, 100) for t in range(5)], "participant string, tno int, m long, mt double, n long")
    store = se.store_events({"s": sacc}, str(tmp_path / "s"), 3, split_rows=split)["s"]
    want = asof.last_before(sacc, pts, "t", {"M": ("m", "mt")}, "n")
    got = asof.last_before(store, pts, "t", {"M": ("m", "mt")}, "n")
    assert sorted(map(tuple, together(got).collect())) == sorted(map(tuple, want.collect())) != []


def test_markers_of_parts_need_the_trial(spark, tmp_path):
    store = se.store_events({"e": fixture(spark, [("p", 1, 1, 0.5), ("q", 1, 1, 0.5)])}, str(tmp_path / "s"), 2)["e"]
    assert isinstance(store.groupBy(*TRIAL).agg(*attach.aggregates({"n": "count(1)"})), Parted)
    assert store.groupBy("tno").count().first()["count"] == 2
    assert not isinstance(store.select("tno"), Parted) and store.select("tno").count() == 2
    assert markers.TRIAL_ATTRIBUTES.keys() == {"dist_region", "response", "response_corr"}
