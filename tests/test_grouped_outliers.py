import numpy as np
import pytest

from tersa.operators import grouped_outliers as go

SCHEMA = "g string, h int, v double, score_in int"


def plain(rows):
    """Scores by group, computed one group after the other."""
    groups, out = {}, []
    for g, h, v, i in rows:
        if v is not None and np.isfinite(v):
            groups.setdefault((g, h), []).append(v)
    for g, h, v, i in rows:
        own = np.array(groups.get((g, h), []))
        if v is None or not np.isfinite(v):
            out.append((i, None))
            continue
        apart = np.abs(own - np.median(own))
        scale = float(np.median(apart)) or float(apart.mean()) * 1.253314
        out.append((i, 0.0 if scale == 0 else 0.6745 * (v - float(np.median(own))) / scale))
    return sorted(out)


def rows_of(rng):
    rows = [("hot", 1, float(v), 0) for v in rng.normal(5, 100, 900)]  # a third of all and more
    rows += [(str(n % 120), n % 2, float(v), 0) for n, v in enumerate(rng.lognormal(0, 3, 1_200))]
    rows += [(None, 0, float(v), 0) for v in rng.integers(-3, 3, 60)]
    rows += [("", 0, float(v), 0) for v in (1, 1, 1, 9)] + [("one", None, 4.0, 0)] * 3
    rows += [("gone", 1, v, 0) for v in (None, float("nan"), float("inf"))]
    rows += [("edge", 2, v, 0) for v in (0.0, -0.0, 5e-324, -5e-324, 1.7e300, -1.7e300, 1.0,
                                          np.nextafter(1.0, 0), np.nextafter(1.0, 2), -1.0, 1e-310)]
    return [(g, h, None if v is None else float(v), i) for i, (g, h, v, _) in enumerate(rows)]


@pytest.mark.parametrize(("limit", "floor"), [(100_000, 1_000_000), (1, 50)])
def test_scores_by_group(spark, limit, floor):
    rows = rows_of(np.random.default_rng(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = go.grouped_outliers(df, "v", ["g", "h"], limit=limit, floor=floor)
    assert out.columns == ["g", "h", "v", "score_in", "score", "is_outlier"]
    got = sorted((r.score_in, r.score) for r in out.collect())
    for (i, a), (j, b) in zip(got, plain(rows), strict=True):
        assert i == j and (a is None) == (b is None), i
        assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9), rows[i]
    flags = {r.score_in: r.is_outlier for r in out.collect()}
    assert all(flags[i] is None if z is None else flags[i] == (abs(z) > 3.5) for i, z in got)


def test_medians_digit_by_digit_equal_sorting(spark):
    rng = np.random.default_rng(9)
    exact = {}
    rows = []
    for n, scale in enumerate((1e-300, 1e-3, 1.0, 1e9, 1e300)):
        for size in (1, 2, 7, 400):
            v = rng.normal(0, 1, size) * scale if scale != 1.0 else np.round(rng.normal(0, 1, size), 1)
            exact[n, size] = float(np.median(v))
            rows += [(n, size, float(x)) for x in v]
    counts = spark.createDataFrame(rows, "n int, size int, x double").groupBy(
        "n", "size", "x").count().withColumnRenamed("count", "n_rows")
    counts = counts.selectExpr("n AS a", "size AS b", "x", "n_rows AS n")
    for limit in (1, 100_000):
        got = {(r.a, r.b): r.median for r in go.group_medians(counts, ["a", "b"], limit).collect()}
        assert got.keys() == exact.keys()
        assert all(got[k] == pytest.approx(exact[k], rel=1e-15) for k in exact)


def test_empty_and_missing(spark):
    df = spark.createDataFrame([("a", 1, None, 1)], SCHEMA)
    assert [tuple(r)[4:] for r in go.grouped_outliers(df, "v", ["g"]).collect()] == [(None, None)]
    assert go.grouped_outliers(df.limit(0), "v", ["g"]).count() == 0
