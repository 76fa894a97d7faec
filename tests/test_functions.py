import math

import numpy as np
import pytest

from trialspark.functions import categories, geometry, nulls, sql, student_t


def one(spark, expression):
    return spark.sql(f"SELECT {expression} AS x").first()["x"]


# ---- unknowns stay unknown ----


@pytest.mark.parametrize("cond, expected", [("true", 1), ("false", 2), ("CAST(NULL AS BOOLEAN)", None)])
def test_ifelse3(spark, cond, expected):
    assert one(spark, nulls.ifelse3(cond, "1", "2")) == expected


def test_isin_safe_is_false_for_null(spark):
    assert one(spark, nulls.isin_safe("CAST(NULL AS INT)", [1, 2])) is False
    assert one(spark, nulls.isin_safe("2", [1, 2])) is True


def test_aggregates_on_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0)], "g string, v double")
    exprs = {"m": nulls.mean_strict("v"), "hit": nulls.any_true("v > 5")}
    got = {r["g"]: (r["m"], r["hit"]) for r in df.groupBy("g").agg(*sql.aggregates(exprs)).collect()}
    assert got == {"a": (None, False), "b": (2.0, False)}
    empty = df.where("v > 100").agg(*sql.aggregates({"hit": nulls.any_true("v > 0")}))
    assert empty.first()["hit"] is False


# ---- categories ----


def test_recode_and_rank(spark):
    labels = {"resp": "Go", "inhibit": "No-go"}
    assert one(spark, categories.recode("'inhibit'", labels)) == "No-go"
    assert one(spark, categories.recode("'other'", labels)) is None
    assert one(spark, categories.recode("CAST(NULL AS STRING)", labels)) is None
    levels = ["low", "mid", "it's high"]
    assert one(spark, categories.rank_of(sql.literal("it's high"), levels)) == 3
    assert one(spark, categories.rank_of("'none'", levels)) is None
    assert one(spark, categories.rank_of("CAST(NULL AS STRING)", levels)) is None
    assert one(spark, categories.label_at("2", levels)) == "mid"


# ---- geometry ----


def test_item_lookup(spark):
    assert one(spark, geometry.item_x("1")) == pytest.approx(6 * math.cos(math.radians(30)))
    assert one(spark, geometry.item_y("10")) == pytest.approx(6 * math.sin(math.radians(330)))
    assert one(spark, geometry.item_x("0")) is None
    assert one(spark, geometry.item_x("CAST(NULL AS INT)")) is None


def test_distance(spark):
    assert one(spark, geometry.distance("0D", "0D", "3D", "4D")) == pytest.approx(5)


# ---- Student t ----

KNOWN = {4: 2.776445105, 8: 2.306004135, 14: 2.144786688, 29: 2.045229642, 60: 2.000297822}


@pytest.mark.parametrize("df, value", KNOWN.items())
def test_t_quantile(spark, df, value):
    assert student_t.quantile(df) == pytest.approx(value, abs=1e-9)
    assert one(spark, student_t.t975(f"{df}L")) == pytest.approx(value, abs=1e-9)


def test_t_quantile_edges(spark):
    assert one(spark, student_t.t975("0L")) is None
    assert one(spark, student_t.t975("CAST(NULL AS BIGINT)")) is None
    assert one(spark, student_t.t975("1L")) == pytest.approx(12.7062047364, abs=1e-8)
    # the table and the expansion meet without a step
    below, above = one(spark, student_t.t975("60L")), one(spark, student_t.t975("61L"))
    assert 0 < below - above < 1e-3
    assert student_t.central_probability(above, 61) == pytest.approx(0.95, abs=1e-9)


def test_published_interval_ratio():
    # ratio ci / se of three published cells, 15 participants
    cells = [
        (12.4962246925977, 26.8017363699133),
        (7.22792251030914, 15.5023519814125),
        (13.4490393110439, 28.8453204796102),
    ]
    for se, ci in cells:
        assert ci / se == pytest.approx(student_t.quantile(14), abs=1e-10)


def central(t, df):
    """P(-T < t < T), by quadrature in a variable in which the density is smooth at both ends."""
    x, w = np.polynomial.legendre.leggauss(400)
    scale = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    if df > 2 or t * t < df:
        angle = math.atan(t / math.sqrt(df))
        return scale * angle / 2 * float(w @ np.cos(angle / 2 * (x + 1)) ** (df - 1))
    # the tail: sin of the complement to the power df - 1, with s = sin^df
    top = (df / (df + t * t)) ** (df / 2)
    s = top / 2 * (x + 1)
    return 1 - scale * top / 2 / df * float(w @ (1 - s ** (2 / df)) ** -0.5)


@pytest.mark.parametrize("level", [0.9, 0.95, 0.99, 0.999])
def test_t_quantile_at_any_df(spark, level):
    dfs = [0.5, 0.8, 1.0, 1.7, 2.0, 3.3, 5.0, 14.0, 29.5, 60.0, 333.3, 5000.0]
    df = spark.createDataFrame([(d,) for d in dfs], "d double")
    for r in df.selectExpr("d", f"{student_t.t_quantile((1 + level) / 2, 'd')} AS t").collect():
        step = 1e-9 * r["t"]
        assert central(r["t"] - step, r["d"]) < level < central(r["t"] + step, r["d"])
    exact = spark.sql(f"SELECT {student_t.t_quantile((1 + level) / 2, '1')} AS a, {student_t.t_quantile((1 + level) / 2, '2D')} AS b").first()
    assert exact["a"] == pytest.approx(math.tan(math.pi / 2 * level), rel=1e-9)
    assert exact["b"] == pytest.approx(level * math.sqrt(2 / (1 - level**2)), rel=1e-9)


def test_t_quantile_meets_the_table_and_the_normal(spark):
    for n in (1, 4, 14, 29, 60, 149, 1000):
        row = spark.sql(f"SELECT {student_t.t_quantile(0.975, str(n))} AS t, {student_t.t975(str(n))} AS table").first()
        assert row["t"] == pytest.approx(row["table"], rel=2e-9)
    # the expansion in 1 / df about the normal, far out
    far = spark.sql(f"SELECT {student_t.t_quantile(0.975, '1e6D')} AS t").first()["t"]
    assert far == pytest.approx(student_t.quantile(10**6), rel=1e-9)
    odd = spark.sql(f"SELECT {student_t.t_quantile(0.975, '0')} AS a, {student_t.t_quantile(0.975, 'CAST(NULL AS DOUBLE)')} AS b, {student_t.t_quantile(0.975, '-1D')} AS c").first()
    assert tuple(odd) == (None, None, None)
    with pytest.raises(ValueError):
        student_t.t_quantile(0.5, "d")
