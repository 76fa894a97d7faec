import datetime
import random

import pytest

from trialspark.operators import lagged, positions, reshape, trial_log

COLS = positions.ORIENTATION_COLUMNS


def orientations(prefix):
    return [float(v) if v is not None else None for v in prefix] + [0.0] * (10 - len(prefix))


@pytest.mark.parametrize(
    "prefix, expected",
    [
        ([0, 12, 0, 90, -168], (2, 5, 4)),
        ([0, 0, 0, 0, 12], (5, None, 0)),
        ([None, 0, 0, 0, 0], (None, None, 0)),
        ([-12, 168, 270, 90, 12], (1, 2, 3)),
    ],
)
def test_item_positions(spark, rows, prefix, expected):
    df = spark.createDataFrame([orientations(prefix)], ", ".join(f"{c} double" for c in COLS))
    assert rows(positions.item_positions(df), "tar1_pos", "tar2_pos", "dist_pos") == [expected]


def test_kth_match_for_any_mask(spark):
    for mask in (0, 1, 2, 6, 0b1011000101, 1 << 9):
        bits = [i + 1 for i in range(10) if mask >> i & 1] + [None] * 3
        asked = ", ".join(positions.kth_match(str(mask), k) for k in (1, 2, 3))
        assert tuple(spark.sql(f"SELECT {asked}").first()) == tuple(bits[:3])


def test_distractor_region(spark, rows):
    data = [(0, "freq_bottom"), (6, "freq_bottom"), (5, "freq_bottom"), (6, "freq_top"), (5, "freq_top"), (3, None), (None, "freq_top")]
    df = spark.createDataFrame(data, "dist_pos int, dist_freq string")
    got = [(r["dist_region"], r["distractor"]) for r in positions.distractor_region(df).collect()]
    assert got == [
        ("Absent", "Absent"), ("Freq.", "Present"), ("Rare", "Present"), ("Rare", "Present"),
        ("Freq.", "Present"), (None, "Present"), (None, None),
    ]


def test_target_regions(spark):
    data = [(1, 7, "freq_bottom", 2), (6, 7, "freq_bottom", 1), (1, 2, "freq_bottom", None), (1, None, "freq_top", 1)]
    df = spark.createDataFrame(data, "tar1_pos int, tar2_pos int, dist_freq string, first_target_id int")
    out = positions.first_target_region(positions.target_regions(df)).collect()
    assert [(r["tar_regions"], r["first_region_fixed"]) for r in out] == [
        ("Freq./Rare dist.", "Frequent"), ("Freq. dist.", "Frequent"), ("Rare dist.", None), (None, "Frequent"),
    ]


def test_distractor_repeat(spark):
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate([4, 4, 0, 4, 5, 0])], "participant string, tno int, dist_pos int")
    got = [r["dist_rep"] for r in positions.distractor_repeat(df).orderBy("tno").collect()]
    assert got == [None, "Repeat", "Absent", "Change", "Change", "Absent"]


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_previous_value_does_not_depend_on_blocks(spark, rows, block):
    rnd = random.Random(block)
    data = []
    for p in "abc":
        for t in sorted(rnd.sample(range(-20, 60), 30)):
            data.append((p, t, rnd.choice([None, 1, 2, 3])))
    expected, last = [], {}
    for p, t, v in data:
        expected.append((p, t, v, last.get(p)))
        last[p] = v
    df = spark.createDataFrame(rnd.sample(data, len(data)), "g string, t int, v int")
    got = lagged.previous_value(df, ["g"], "t", "v", "prev", block=block)
    key = lambda r: (r[0], r[1])
    assert sorted([tuple(r) for r in got.select("g", "t", "v", "prev").collect()], key=key) == sorted(expected, key=key)


def test_trial_blocks_and_validity(spark, rows):
    df = spark.createDataFrame(
        [("a", None, 0, "resp", 1, 0.5), ("a", 1, None, "resp", 1, 0.5), ("a", 2, None, "inhibit", 1, None),
         ("a", 3, None, "resp", 1, 0.2), ("a", 4, None, "odd", 1, 0.9), ("a", 5, None, "resp", 0, 0.9)],
        "participant string, trials_thisN int, practice_trials_thisRepN int, response string, response_corr int, response_rt double",
    )
    blocks = trial_log.trial_blocks(df)
    assert rows(blocks, "tno", "blocktype")[0] == (0, "Practice")
    trials = trial_log.label_response(trial_log.experiment_trials(df))
    assert rows(trials, "tno", "response") == [(1, "Go"), (2, "No-go"), (3, "Go"), (4, None), (5, "Go")]
    assert rows(trial_log.valid_go(trials), "tno") == [(1,)]
    assert rows(trial_log.valid_go(trials, min_rt=None), "tno") == [(1,), (3,)]


def test_wide_long_round_trip(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, None), ("a", 2, 4.0, None, 6.0)], "p string, t int, x double, y double, z double")
    long = reshape.to_long(df, ["p", "t"], ["x", "y", "z"], "loc", "v")
    assert long.count() == 6
    assert rows(reshape.to_wide(long, ["p", "t"], "loc", ["x", "y", "z"], "v")) == rows(df)


def test_spread_statistics(spark, rows):
    df = spark.createDataFrame([("A", 1.0, 2.0, 0.1, 0.2)], "c string, m_before double, m_after double, ci_before double, ci_after double")
    got = reshape.spread_statistics(df, ["c"], ["m", "ci"], ["before", "after"], "phase")
    assert rows(got, "phase", "m", "ci") == [("after", 2.0, 0.2), ("before", 1.0, 0.1)]


# ---- previous row by any order ----


def brute_previous(data, order_of):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    out = []
    for group in groups.values():
        group.sort(key=order_of)
        out += [(*r, group[i - 1][-1] if i else None) for i, r in enumerate(group)]
    return sorted(map(str, out))


def nulls_first(*values):
    return tuple((v is not None, v if v is not None else 0) for v in values)


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("kind", ["timestamp", "bigint", "string", "double"])
def test_previous_in_order(spark, kind, parts):
    rnd = random.Random(parts)
    make = {
        "timestamp": lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rnd.randrange(10**6) * 10**6),
        "bigint": lambda: rnd.randrange(-(2**62), 2**62),
        "string": lambda: rnd.choice("abcdefghij") * rnd.randint(0, 3),
        "double": lambda: rnd.gauss(0, 1),
    }[kind]
    data = [(rnd.choice(["long"] * 20 + ["a", "b", None]), make() if rnd.random() > 0.05 else None, i, rnd.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(data, f"g string, t {kind}, i int, v int").repartition(5)
    got = lagged.previous_in_order(df, ["g"], ["t", "i"], "v", "p", parts)
    assert got.columns == ["g", "t", "i", "v", "p"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_previous(data, lambda r: nulls_first(r[1], r[2]))


def test_previous_with_full_ties(spark):
    """Rows that tie in the order follow one another by value."""
    data = [("g", 1, v) for v in (3, None, 1, 1)] + [("g", 2, 0)]
    got = lagged.previous_in_order(spark.createDataFrame(data, "g string, t int, v int"), ["g"], ["t"], "v", "p", 4)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_previous(data, lambda r: nulls_first(r[1], r[2]))
    assert lagged.previous_in_order(spark.createDataFrame([], "g string, t int, v int"), ["g"], ["t"], "v", "p").count() == 0


def test_a_long_group_is_spread_over_tasks(spark):
    df = spark.range(20_000).selectExpr("'one' AS g", "id * 7 % 20011 AS t", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lag = lagged.previous_in_order(df, ["g"], ["t"], "v", "p", 16)
        sizes = [r["count"] for r in lag.selectExpr("spark_partition_id() AS s").groupBy("s").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 9_000
