import math
import random
import statistics

import pytest

from trialspark.functions.student_t import quantile
from trialspark.operators import errors, exclude, summarize
from trialspark.plans import behaviour


def within_by_hand(data):
    """Definition on raw rows: {cond: (n, m, se, ci)} from (participant, cond, value)."""
    means = {p: statistics.fmean([v for q, _, v in data if q == p]) for p, _, _ in data}
    out = {}
    for c in {c for _, c, _ in data}:
        raw = [v for _, k, v in data if k == c]
        centred = [v - means[p] for p, k, v in data if k == c]
        n = len(raw)
        se = statistics.stdev(centred) / math.sqrt(n - 1) if n > 1 else None
        out[c] = (n, statistics.fmean(raw), se, se * quantile(n - 1) if n > 1 else None)
    return out


def run(spark, data, by=("cond",)):
    df = spark.createDataFrame(data, "participant string, cond string, rt double")
    return {r["cond"]: (r["n"], r["m_rt"], r["se_rt"], r["ci_rt"]) for r in errors.within_error(df, list(by), {"rt": "rt"}).collect()}


def close(got, expected):
    assert got.keys() == expected.keys()
    for k, row in expected.items():
        assert got[k] == tuple(v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in row)


def test_within_error_worked_example(spark):
    data = [("a", "F", 1000.0), ("a", "R", 1100.0), ("b", "F", 1200.0), ("b", "R", 1340.0), ("c", "F", 900.0), ("c", "R", 960.0)]
    got = run(spark, data)
    for cond, m in (("F", 1033.333333), ("R", 1133.333333)):
        assert got[cond] == (3, pytest.approx(m, abs=1e-6), pytest.approx(14.142136, abs=1e-6), pytest.approx(60.848698, abs=1e-6))


@pytest.mark.parametrize("seed", range(4))
def test_within_error_on_unbalanced_raw_rows(spark, seed):
    rnd = random.Random(seed)
    data = [(f"p{rnd.randint(0, 6)}", rnd.choice("ABC"), rnd.gauss(1000, 50)) for _ in range(rnd.randint(30, 90))]
    close(run(spark, data), within_by_hand(data))


def test_shifting_a_participant_keeps_the_error(spark):
    rnd = random.Random(1)
    data = [(p, c, rnd.gauss(0, 1)) for p in "abcd" for c in "XY" for _ in range(2)]
    shifted = [(p, c, v + 100 * ord(p)) for p, c, v in data]
    a, b = run(spark, data), run(spark, shifted)
    for c in "XY":
        assert b[c][2] == pytest.approx(a[c][2], rel=1e-7)


def test_single_row_and_missing_values(spark):
    assert run(spark, [("a", "F", 1.0)]) == {"F": (1, 1.0, None, None)}
    data = [("a", "F", 1.0), ("a", "R", None), ("b", "F", 2.0), ("b", "R", 4.0), ("b", "S", 1.0), ("c", "S", 5.0), ("c", "S", 6.0)]
    got = run(spark, data)
    assert got["F"] == (2, 1.5, None, None)  # a's mean is unknown
    assert got["R"] == (2, None, None, None)
    assert got["S"][:2] == (3, 4.0) and got["S"][2] is not None


def test_between_error(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("A", 8.0), ("B", 2.0), ("C", None)], "c string, v double")
    got = {r["c"]: (r["n"], r["m_v"], r["se_v"]) for r in errors.between_error(df, ["c"], "v", "v").collect()}
    assert got["A"] == (3, 4.0, pytest.approx(statistics.stdev([1, 3, 8]) / math.sqrt(2)))
    assert got["B"] == (1, 2.0, None) and got["C"] == (1, None, None)


def test_two_level_mean_is_unweighted(spark):
    df = spark.createDataFrame([("p", 1, 10.0), ("p", 1, 20.0), ("p", 1, 30.0), ("p", 2, 100.0)], "participant string, tno int, v double")
    assert summarize.two_level_mean(df, ["participant"], "v", "m").first()["m"] == 60.0


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(p, c) for p in ("x", None) for c in "aabc"], "panel string, cat string")
    out = summarize.share_within(df, ["panel"], "cat").collect()
    for panel in ("x", None):
        part = [r for r in out if r["panel"] == panel]
        assert sum(r["share"] for r in part) == pytest.approx(1)
        assert {r["cat"]: r["n"] for r in part} == {"a": 2, "b": 1, "c": 1}


CELLS = [("a", "F", 1.0), ("a", "R", 2.0), ("b", "F", 1.0), ("c", "R", None), ("c", "F", 1.0), ("d", None, 1.0)]


def test_completeness_rules(spark):
    df = spark.createDataFrame(CELLS, "participant string, region string, v double")
    need = ["region = 'F'", "region = 'R'"]
    who = lambda d: sorted({r["participant"] for r in d.collect()})
    assert who(exclude.participants_with(df, need)) == ["a", "c"]
    assert who(exclude.keep_participants(df, exclude.participants_with(df, need))) == ["a", "c"]
    assert who(exclude.keep_with_cells(df, need)) == ["a", "c"]
    assert who(exclude.keep_with_count(df, 1)) == ["b", "d"]
    assert who(exclude.participants_missing(df, ["v", "region"])) == ["c", "d"]
    assert who(exclude.drop_participants(df, exclude.participants_missing(df, ["v"]))) == ["a", "b", "d"]
    assert who(exclude.drop_with_missing(df, ["v", "region"])) == ["a", "b"]
    assert exclude.keep_with_cells(df, need).columns == df.columns


def test_logs_of_two_experiments_in_one_pass(spark, rows):
    def log(offset):
        data = [(p, t, "Absent", "Go", 1, 0.5 + offset + t / 100, "Absent") for p in ("a", "b") for t in range(4)]
        return spark.createDataFrame(data, "participant string, tno int, dist_region string, response string, response_corr int, response_rt double, dist_rep string")

    logs = {"exp1": log(0.0), "exp2": log(0.3)}
    apart = behaviour.side_by_side({name: behaviour.norep_rt(df) for name, df in logs.items()})
    together = behaviour.norep_rt(behaviour.tagged_logs(logs), ["experiment"])
    names = ["experiment", "dist_region", "n", "m_rt", "se_rt", "ci_rt"]
    assert [r[:3] for r in rows(together, *names)] == [r[:3] for r in rows(apart, *names)]
    assert [round(r[3], 6) for r in rows(together, *names)] == [round(r[3], 6) for r in rows(apart, *names)]


def test_names_that_need_quoting(spark, rows):
    df = spark.createDataFrame([("a", "F", 1000.0), ("a", "R", 1100.0), ("b", "F", 1200.0), ("b", "R", 1340.0)], "`my subject` string, `my cond` string, `a rt` double")
    out = errors.within_error(df, ["my cond"], {"mean rt": "`a rt`"}, subject="my subject")
    assert out.columns == ["my cond", "n", "m_mean rt", "se_mean rt", "ci_mean rt"]
    assert [r["m_mean rt"] for r in out.orderBy("`my cond`").collect()] == [1100.0, 1220.0]


def test_sum_at_first_adds_up_ties(spark, rows):
    data = [("a", 2, 1.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", 5, None), ("b", 5, 1.0), ("c", None, 9.0), ("c", 7, 4.0), (None, 1, 0.5), ("d", None, 1.0)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    assert rows(summarize.sum_at_first(df, ["g"], "i", "v", "s")) == [("a", 5.0), ("b", None), ("c", 4.0), (None, 0.5)]
    assert summarize.sum_at_first(df.limit(0), ["g"], "i", "v", "s").count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_merged_cells_equal_one_pass(spark, parts):
    rnd = random.Random(parts)
    data = [(f"s{rnd.randrange(7)}", rnd.choice("xyz"), 1e6 + rnd.gauss(0, 1), rnd.random() if rnd.random() > 0.01 else None, i % parts) for i in range(500)]
    df = spark.createDataFrame(data, "participant string, c string, v double, w double, part int")
    measures = {"v": "v", "w": "w"}
    want = errors.within_error(df, ["c"], measures)
    states = [errors.error_cells(df.where(f"part = {p}"), ["c"], measures) for p in range(parts)]
    merged = errors.merge_cells(states, ["c"])
    assert merged.columns == states[0].columns
    got = errors.error_of_cells(merged, ["c"], list(measures))
    for a, b in zip(got.orderBy("c").collect(), want.orderBy("c").collect(), strict=True):
        assert (a["c"], a["n"]) == (b["c"], b["n"])
        for x, y in zip(a[2:], b[2:], strict=True):
            assert x is y is None or x == pytest.approx(y, rel=1e-6)
    # a day that comes later joins the state that is there
    step = states[0]
    for s in states[1:]:
        step = errors.merge_cells([step, s], ["c"])
    assert sorted((r["participant"], r["c"], r["_n"], round(r["_mean0"], 6)) for r in step.collect()) == sorted((r["participant"], r["c"], r["_n"], round(r["_mean0"], 6)) for r in merged.collect())


def test_other_levels(spark):
    df = spark.createDataFrame([(p, c, float(hash((p, c)) % 97)) for p in range(9) for c in "ab"], "participant int, c string, v double")
    narrow, wide = (errors.within_error(df, ["c"], {"v": "v"}, level=level).orderBy("c").collect() for level in (0.9, 0.99))
    for a, b in zip(narrow, wide):
        assert a["ci_v"] / a["se_v"] == pytest.approx(1.8595480375) and b["ci_v"] / b["se_v"] == pytest.approx(3.3553873313)
