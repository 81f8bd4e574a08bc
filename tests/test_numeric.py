import numpy as np
import pytest

from tersa.operators import numeric


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def fit(spark, values, **kw):
    return numeric.fit_models(frame(spark, values), {"income": "v"}, **kw)["income"]


@pytest.mark.parametrize("limit", [100_000, 5])
def test_median_and_mad(spark, limit):
    rng = np.random.default_rng(7)
    for values in (rng.normal(45000, 12000, 500), rng.normal(0, 1, 501), rng.integers(0, 9, 400)):
        model = fit(spark, values, exact_limit=limit)
        median = float(np.median(values))
        assert model.median == median
        assert model.mad == float(np.median(np.abs(values - median)))


@pytest.mark.parametrize("limit", [100_000, 20])
def test_fields_fitted_together_are_as_apart(spark, limit):
    rng = np.random.default_rng(3)
    columns = {"a": rng.normal(0, 9, 700).round(2), "b": rng.integers(0, 30, 700).astype(float),
               "c": np.r_[np.zeros(400), rng.normal(5, 1, 300)], "d": np.full(700, 7.0)}
    rows = [tuple(map(float, r)) + (None,) for r in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame([*rows, (None, float("nan"), None, None, None)],
                               "a double, b double, c double, d double, e double")
    models = numeric.fit_models(df, {c: c for c in "abcde"}, exact_limit=limit)
    for c, values in columns.items():
        assert models[c].n_fitted == 700 and models[c].median == np.median(values)
        assert models[c].mad == np.median(np.abs(values - np.median(values)))
    assert [models[c].fallback for c in "abcde"] == [
        None, None, "mean_abs_dev", "constant", "empty"]
    assert models["c"].scale == pytest.approx(np.mean(np.abs(columns["c"])) * 1.253314)


def test_robust(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(45000, 12000, 500)
    clean, dirty = fit(spark, base), fit(spark, [*base, 2_500_000])
    assert abs(clean.median - dirty.median) / clean.median < 0.01
    flagged = numeric.mad_outliers(frame(spark, [*base, 2_500_000]), "v")
    assert flagged.where("is_outlier and v = 2500000").count() == 1
    half = fit(spark, [*rng.normal(45000, 12000, 400), *[9_999_999] * 100])
    assert 35_000 < half.median < 55_000


def test_fallbacks(spark):
    flat = fit(spark, [42] * 100)
    assert (flat.fallback, flat.scale, flat.bounds()) == ("constant", 0.0, (42.0, 42.0))
    assert numeric.mad_outliers(frame(spark, [42] * 5), "v").where("score <> 0").count() == 0
    values = [10] * 60 + [11, 12, 9, 8, 500]
    model = fit(spark, values)
    assert model.fallback == "mean_abs_dev"
    assert model.scale == pytest.approx(np.mean(np.abs(np.array(values) - 10)) * 1.253314)
    odd = numeric.mad_outliers(frame(spark, values), "v").where("is_outlier").collect()
    assert [r.v for r in odd] == [500.0]
    empty = fit(spark, [float("nan")] * 2)
    assert (empty.fallback, empty.n_fitted) == ("empty", 0)


def test_heavy_ties_beyond_the_limit(spark):
    values = [1.0] * 300 + [2.0] * 300 + list(np.linspace(3, 4, 300))
    model = fit(spark, values, exact_limit=10)
    assert model.median == float(np.median(values))


def test_text_numbers_and_domain(spark):
    df = spark.createDataFrame(
        [("12",), (" 1e3 ",), ("1d",), ("inf",), ("",), (None,), ("-.5",)], "v string")
    got = [r[0] for r in df.selectExpr(numeric.numeric_value("v", df.schema["v"].dataType)).collect()]
    assert got == [12.0, 1000.0, None, None, None, None, -0.5]
    ages = spark.createDataFrame([(150.0,), (-10.0,), (40.0,)], "v double")
    said = [r[0] is None for r in ages.selectExpr(numeric.domain_message("v", "age")).collect()]
    assert said == [False, False, True]
