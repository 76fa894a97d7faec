import random

import pytest

from trialspark.operators import asof, attach, classify, markers, phases

# ---- classification ----


@pytest.mark.parametrize(
    "x, y, dist_pos, kind, target",
    [
        (0.0, 0.0, 3, "Fixation", None),
        (5.196, 3.0, 3, "Target", 1),
        (0.0, -6.0, 3, "Target", 2),
        (0.0, 6.0, 3, "Distractor", None),
        (0.0, 6.0, 0, "Other", None),
        (0.0, 2.9, 3, "Fixation", None),
        (0.0, 3.5, 3, "Distractor", None),
        (3.6, 4.8, 2, "Distractor", None),
        (-6.0, 0.0, 3, "Other", None),
        (None, None, 3, None, None),
    ],
)
def test_event_class(spark, rows, x, y, dist_pos, kind, target):
    schema = "average_gaze_x double, average_gaze_y double, tar1_pos int, tar2_pos int, dist_pos int"
    df = spark.createDataFrame([(x, y, 1, 8, dist_pos)], schema)
    assert rows(classify.classify(df), "fix_type", "tar_fixed") == [(kind, target)]


@pytest.mark.parametrize(
    "t1, t2, dist, centre, kind, target",
    [
        (2.0, 9.0, 2.0, 6.0, "Target", 1),  # tie with the distractor goes to the target
        (2.5, 2.5, None, 6.0, "Target", 2),  # tie between targets goes to the second
        (3.0, 9.0, None, 6.0, "Other", None),  # area borders are exclusive
        (9.0, 9.0, 3.0, 3.0, "Other", None),
        (2.0, None, None, 6.0, "Target", None),
        (9.0, None, None, 1.0, None, None),
    ],
)
def test_class_from_given_distances(spark, rows, t1, t2, dist, centre, kind, target):
    schema = "tar1_dist double, tar2_dist double, dist_dist double, fix_dist double"
    df = spark.createDataFrame([(t1, t2, dist, centre)], schema)
    assert rows(classify.classify_by_distance(df), "fix_type", "tar_fixed") == [(kind, target)]


def test_circle_outline(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, r double")
    pts = classify.circle_outline(df, "x", "y", "r", npoints=5).orderBy("point").collect()
    got = [(round(p["outline_x"], 9), round(p["outline_y"], 9)) for p in pts]
    assert got == [(4.0, 2.0), (1.0, 5.0), (-2.0, 2.0), (1.0, -1.0), (4.0, 2.0)]


# ---- markers ----

EVENT = (
    "participant string, tno int, fix_count long, cat string, fix_type string, tar_fixed int, start_time double, "
    "duration double, dist_region string, response string, response_corr int"
)


def events(spark, trials):
    """Frames from ``{tno: "1 - d 2"}``: 1 / 2 targets, d distractor, f centre, - other, x not search."""
    out = []
    for tno, text in trials.items():
        for i, s in enumerate(text.split(), 1):
            cat = "Post" if s.startswith("x") else "Search"
            s = s.removeprefix("x")
            kind = {"1": "Target", "2": "Target", "d": "Distractor", "f": "Fixation", "-": "Other", "?": None}[s]
            target = int(s) if s in "12" else None
            out.append(("p", tno, i, cat, kind, target, i / 10, i / 100, "Rare", "Go", 1))
    return spark.createDataFrame(out, EVENT)


SEQUENCES = {
    "- -": "No fix.",
    "x1 x2": "No fix.",
    "1": "Single tar. fix.",
    "- 2 2": "Single tar. fix.",
    "1 2": "Both fix.",
    "1 1 2 2": "Both fix.",
    "2 - 1": "Both fix.",
    "1 2 1": "Refixation",
    "2 1 2": "Refixation",
    "1 2 2 - 2": "Both fix.",
    "1 - 2 1 2": "Refixation",
    "1 2 x1": "Both fix.",
    "1 ? 2 ?": "Both fix.",
}


def test_visit_pattern(spark):
    texts = list(SEQUENCES)
    got = markers.trial_markers(events(spark, dict(enumerate(texts)))).collect()
    assert {texts[r["tno"]]: r["fix_pattern"] for r in got} == SEQUENCES


def test_pattern_ignores_repeat_of_last_event(spark):
    texts = [t for t in SEQUENCES if t.split()[-1] in "12"]
    got = markers.trial_markers(events(spark, {i: f"{t} {t.split()[-1]}" for i, t in enumerate(texts)})).collect()
    assert {texts[r["tno"]]: r["fix_pattern"] for r in got} == {t: SEQUENCES[t] for t in texts}


def test_markers_of_one_trial(spark):
    r = markers.trial_markers(events(spark, {1: "f x2 - d 2 2 1 d 2"})).first()
    assert (r["n_events"], r["n_search"], r["first_search"]) == (9, 8, 1)
    assert (r["first_target"], r["first_target_id"], r["first_target_time"]) == (5, 2, 0.5)
    assert (r["both_targets"], r["both_targets_time"], r["second_target_duration"]) == (7, 0.7, 0.07)
    assert (r["first_distractor"], r["first_distractor_time"]) == (4, 0.4)
    assert r["first_object"] == "Other"


def test_both_targets_equals_its_definition(spark):
    rnd = random.Random(5)
    trials = {i: " ".join(rnd.choices(["1", "2", "d", "-", "x1", "x2"], k=rnd.randint(1, 9))) for i in range(120)}
    got = {r["tno"]: (r["first_target"], r["first_target_id"], r["both_targets"]) for r in markers.trial_markers(events(spark, trials)).collect()}
    for tno, text in trials.items():
        hits = [(i, int(s)) for i, s in enumerate(text.split(), 1) if s in ("1", "2")]
        first = hits[0] if hits else (None, None)
        other = next((i for i, t in hits if t != first[1]), None)
        assert got[tno] == (*first, other)


# ---- phases ----


def brute_phases(text):
    hits = [(i, s) for i, s in enumerate(text.split(), 1) if s in ("1", "2")]
    first = hits[0][0] if hits else None
    both = next((i for i, t in hits if t != hits[0][1]), None) if hits else None
    out = []
    for i, s in enumerate(text.split(), 1):
        if s == "d":
            late = "Between" if both is None or i < both else "After"
            out.append((i, "Before" if first is None or i < first else late))
    return out


@pytest.mark.parametrize("split", [{}, {"split_rows": 0}, {"split_rows": 4}])
def test_phases_and_flags_for_any_split(spark, split):
    rnd = random.Random(11)
    trials = {i: " ".join(rnd.choices(["1", "2", "d", "-"], k=rnd.randint(1, 9))) for i in range(60)}
    trials[100] = "- d 1 d - 2 d"
    ev = events(spark, trials)
    marks = markers.trial_markers(ev)
    got = {}
    for r in phases.distractor_phases(ev, marks, **split).collect():
        got.setdefault(r["tno"], []).append((r["fix_count"], r["dfix_type"]))
    expected = {t: brute_phases(s) for t, s in trials.items()}
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in expected.items() if v}
    assert expected[100] == [(2, "Before"), (4, "Between"), (7, "After")]

    listed = marks.where("tno % 2 = 0")
    flags = phases.trial_phase_flags(ev, listed, ["dist_region"], **split).collect()
    assert {r["tno"]: (r["before"], r["between"], r["after"]) for r in flags} == {
        t: tuple(p in [x for _, x in v] for p in ("Before", "Between", "After")) for t, v in expected.items() if t % 2 == 0
    }
    assert len(flags) == len([t for t in trials if t % 2 == 0])


# ---- joins ----


@pytest.mark.parametrize("split", [{}, {"split_rows": 0}, {"split_rows": 5}])
def test_full_join_for_any_split(spark, split):
    fx = [("p", t, i) for t in (1, 2, 3, 9) for i in range(t * 3)]
    tr = [("p", t, f"r{t}") for t in (1, 2, 3, 4, 5)]
    out = attach.enrich_full(
        spark.createDataFrame(fx, "participant string, tno int, fix_count int"),
        spark.createDataFrame(tr, "participant string, tno int, dist_rep string"),
        **split,
    )
    reps = {t: r for _, t, r in tr}
    expected = [(p, t, i, reps.get(t)) for p, t, i in fx] + [("p", t, None, f"r{t}") for t in (4, 5)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected, key=key)


def test_heavy_trials_are_not_capped(spark):
    """Every trial above both limits is split, however many there are."""
    ev = spark.range(24_000).selectExpr("'p' AS participant", "CAST(id % 3000 AS INT) AS tno", "id AS fix_count")
    side = attach.row_counts(ev, name="n").selectExpr("*", "tno AS v")
    out = attach.attach(ev, side, "n", split_rows=4, keep_lane=True)
    assert out.where("_lane = 0").count() == 0 and out.where("v = tno").count() == 24_000


def test_share_limits_the_heavy_trials(spark, monkeypatch):
    monkeypatch.setattr(attach, "HEAVY_KEYS", 3)
    ev = spark.range(100).selectExpr("'p' AS participant", "CAST(if(id < 60, 0, id) AS INT) AS tno", "id AS fix_count")
    out = attach.attach(ev, attach.row_counts(ev, name="n").selectExpr("*", "1 AS v"), "n", split_rows=0, keep_lane=True)
    assert {r["tno"] for r in out.where("_lane > 0").collect()} == {0}


def test_attributes_must_be_constant(spark):
    ev = events(spark, {1: "1 d 2"}).selectExpr("* EXCEPT (response)", "CASE WHEN fix_count < 3 THEN 'Go' END AS response")
    with pytest.raises(Exception, match="attributes differ"):
        markers.trial_markers(ev).collect()


def test_every_event_is_labelled(spark):
    ev = events(spark, {1: "- d 1 d - 2 d", 2: "-"})
    got = {(r["tno"], r["fix_count"]): r["dfix_type"] for r in phases.label_phases(ev, markers.trial_markers(ev)).collect()}
    assert len(got) == 8 and {k: v for k, v in got.items() if v} == {(1, 2): "Before", (1, 4): "Between", (1, 7): "After"}


def test_weight_only_steers_movement(spark):
    ev = spark.createDataFrame([("p", 1, i) for i in range(10)], "participant string, tno int, i int")
    for weight in (None, 0, 5, 10**12):
        side = spark.createDataFrame([("p", 1, "v", weight)], "participant string, tno int, v string, w long")
        out = attach.attach(ev, side, "w", split_rows=4)
        assert out.columns == ["participant", "tno", "i", "v"]
        assert sorted((r["i"], r["v"]) for r in out.collect()) == [(i, "v") for i in range(10)]


def test_hot_trial_is_spread_over_tasks(spark):
    """A trial with most of the rows must not end up in one shuffle partition."""
    ev = spark.range(20_000).selectExpr("'p' AS participant", "CAST(if(id < 18000, 0, id % 50) AS INT) AS tno", "id AS fix_count")
    side = attach.row_counts(ev, name="n").selectExpr("*", "tno * 2 AS v")
    out = attach.attach(ev, side, "n", split_rows=5_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy("fix_count", "v", "tno").count().selectExpr("spark_partition_id() AS p").groupBy("p").count().selectExpr("count AS n").collect()]
        joined = out.selectExpr("spark_partition_id() AS p", "v", "tno").where("v = tno * 2").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000
    counts = [r["count"] for r in joined]
    assert sum(counts) == 20_000 and max(counts) < 5_000


# ---- as-of ----


@pytest.mark.parametrize("split", [{}, {"split_rows": 0}])
def test_last_before(spark, rows, split):
    sacc = [
        ("p", 1, 0.1, "Search"), ("p", 1, 0.3, "Search"), ("p", 1, 0.5, "Search"),  # strictly before 0.5 -> 0.3
        ("p", 2, 0.1, "Search"), ("p", 2, 0.3, "Post"),  # the last one is not a search saccade
        ("p", 3, 0.2, "Search"), ("p", 3, 0.2, "Search"), ("p", 3, 0.2, "Post"),  # ties are kept
        ("p", 4, 0.9, "Search"),  # nothing before the point
        ("p", 5, 0.1, "Search"),  # no point
        ("q", 1, 0.1, "Search"),  # no such trial
    ]
    pts = [("p", 1, 7, 0.5, 6, 0.2, 3), ("p", 2, 7, 0.5, None, None, 2), ("p", 3, 7, 0.5, None, None, 3), ("p", 4, 7, 0.5, 1, 0.9, 1), ("p", 5, None, None, None, None, 1)]
    out = asof.last_before(
        spark.createDataFrame(sacc, "participant string, tno int, t double, cat string"),
        spark.createDataFrame(pts, "participant string, tno int, m long, mt double, d long, dt double, n long"),
        "t",
        {"M": ("m", "mt"), "D": ("d", "dt")},
        "n",
        **split,
    )
    got = rows(out.where("cat = 'Search'"), "type", "tno", "t", "marker", "marker_time")
    assert got == [("D", 1, 0.1, 6, 0.2), ("M", 1, 0.3, 7, 0.5), ("M", 3, 0.2, 7, 0.5), ("M", 3, 0.2, 7, 0.5)]


def test_filters_on_attributes_do_not_reach_the_check(spark):
    ev = events(spark, {1: "1 d 2", 2: "2 1"}).selectExpr("* EXCEPT (response_corr)", "CAST(tno - 1 AS INT) AS response_corr")
    marks = markers.trial_markers(ev)
    assert [r["tno"] for r in marks.where("response_corr = 1 AND n_events = 2").collect()] == [2]
    assert marks.where("response_corr = 0 AND response = 'Go' AND dist_region = 'Rare'").count() == 1


def test_unknown_labels_and_missing_keys_raise(spark):
    ev = events(spark, {1: "1 d 2"})
    with pytest.raises(Exception, match="outside its levels"):
        markers.trial_markers(ev.selectExpr("* EXCEPT (response)", "'Perhaps' AS response")).collect()
    for key in ("participant", "tno", "fix_count"):
        lacking = ev.selectExpr(f"* EXCEPT ({key})", f"CASE WHEN start_time < 0.25 THEN {key} END AS {key}")
        with pytest.raises(Exception, match="lacks its key"):
            markers.trial_markers(lacking).select("first_target").collect()


def test_repeated_keys_raise_on_demand(spark):
    ev = events(spark, {1: "1 d 2 1", 2: "d"})
    assert sorted(map(tuple, markers.trial_markers(ev, unique_keys=True).collect())) == sorted(map(tuple, markers.trial_markers(ev).collect()))
    with pytest.raises(Exception, match="key is repeated"):
        markers.trial_markers(ev.union(ev.where("fix_count = 2 AND tno = 1")), unique_keys=True).collect()


def test_other_attributes(spark):
    ev = events(spark, {1: "1 d 2"}).selectExpr("*", "CAST(NULL AS DOUBLE) AS weight")
    row = markers.trial_markers(ev, {"weight": None, "response": ("Go",)}).first()
    assert row["weight"] is None and row["response"] == "Go" and "dist_region" not in row.asDict()
    assert markers.trial_markers(ev, {}).first()["n_events"] == 3
