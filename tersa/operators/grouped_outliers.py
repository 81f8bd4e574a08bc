"""Outliers within groups: median and MAD of each group of rows, however many or large.

Values are counted first (one record per group and value, a partial aggregate), so a
value that fills a third of the table is one record. While every group has at most
``limit`` different values, the built-in percentile over those counts gives all medians in one
aggregate. Otherwise the middle ranks are found digit by digit, for all groups at
once: a double is four digits (binary exponent and three stretches of the mantissa)
that order as the number does. At each digit the counts per group and digit, of
which there are at most ``2 ** 19`` a group, are summed along until the bucket that
holds the rank, and only that bucket is opened. No step sorts more than one
digit of a group, joins more than that on a key, or depends on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import case, ident, literal, select
from ..session import materialize
from .numeric import EXACT_LIMIT, numeric_value
from .skew import MIN_HEAVY_ROWS, attach

_BITS = (18, 18, 17)  # of the mantissa, after the exponent
_DIGITS = [f"__d{i}" for i in range(1 + len(_BITS))]


def _with_digits(counts: DataFrame) -> DataFrame:
    """Adds the digits of ``x``; by them in turn, numbers are in order."""
    exponent = "CAST(floor(log2(abs(x))) AS INT)"
    stages = [{"__sign": "IF(x < 0, -1, 1)", "__e": f"IF(x = 0, NULL, {exponent})"},
              {"__r": "IF(x = 0, 0.0D, abs(x) / pow(2.0D, __e))",
               _DIGITS[0]: "IF(x = 0, 0, __sign * (__e + 1100))"}]
    out = counts
    for stage in stages:
        out = select(out, stage)
    for name, bits in zip(_DIGITS[1:], _BITS, strict=True):
        out = select(out, {"__r": f"__r * {1 << bits}"}, keep=[c for c in out.columns if c != "__r"])
        out = select(out, {name: "__sign * CAST(floor(__r) AS INT)"})
        out = select(out, {"__r": "__r - floor(__r)"}, keep=[c for c in out.columns if c != "__r"])
    return out.drop("__r", "__e", "__sign")


def _by_digits(counts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, median`` from counts of values and ``sizes`` (keys, rows)."""
    ranked = sizes.select(*keys, F.explode(F.array_distinct(F.expr(
        "array((rows + 1) div 2, rows div 2 + 1)"))).alias("rank"))
    coded = _with_digits(counts)
    found, known = ranked, list(keys)
    for digit in _DIGITS:
        buckets = coded.groupBy(*known, digit).agg(F.sum("n").alias("n"))
        along = Window.partitionBy(*known).orderBy(digit)
        # All ranks of a prefix are looked up in one pass along its buckets.
        asked = found.groupBy(*known).agg(F.collect_list("rank").alias("ranks"))
        upto = buckets.join(asked, known).withColumn("upto", F.sum("n").over(along))
        found = upto.select(*known, digit, F.explode(F.expr(
            "transform(filter(ranks, r -> r > upto - n AND r <= upto), r -> r - (upto - n))"
        )).alias("rank"))
        known = [*known, digit]
        if digit != _DIGITS[-1]:
            found = materialize(found, "ranks")  # a row or two per group
    values = coded.groupBy(*known).agg(F.min("x").alias("x"))
    return found.join(values, known).groupBy(*keys).agg(F.avg("x").alias("median"))


def group_medians(counts: DataFrame, keys: list[str], limit: int = EXACT_LIMIT) -> DataFrame:
    """``keys, median, rows, kinds`` (different values) from ``keys, x, n``."""
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    most = sizes.agg(F.max("kinds")).head()[0] or 0
    if most <= limit:
        return counts.groupBy(*keys).agg(
            F.expr("percentile(x, 0.5D, n)").alias("median"), F.sum("n").alias("rows"),
            F.count("*").alias("kinds"))
    return _by_digits(counts, sizes, keys).join(sizes, keys)


def group_models(values: DataFrame, keys: list[str], limit: int = EXACT_LIMIT,
                 floor: int = MIN_HEAVY_ROWS) -> DataFrame:
    """``keys, median, mad, scale, rows, fallback`` of each group of ``values`` (keys, x).

    Where half of a group's values are equal, the mean deviation takes the place of
    the MAD, as for a whole column; a group of one value has scale zero.
    """
    counts = materialize(values.where("x IS NOT NULL").groupBy(*keys, "x").agg(
        F.count("*").alias("n")), "counts")
    centre = materialize(group_medians(counts, keys, limit), "medians")
    apart = materialize(
        attach(counts, centre.select(*keys, "median", "kinds"), keys, "kinds", floor)
        .withColumn("x", F.abs(F.col("x") - F.col("median")))
        .groupBy(*keys, "x").agg(F.sum("n").alias("n")), "deviations")
    spread = group_medians(apart, keys, limit).select(*keys, F.col("median").alias("mad"))
    means = apart.groupBy(*keys).agg((F.sum(F.expr("x * n")) / F.sum("n")).alias("__mean"))
    told = centre.join(spread, keys).join(means, keys)
    instead = f"__mean * {literal(fixed.MEAN_DEV_TO_MAD)}"
    return select(told, {
        "scale": f"IF(mad > 0, mad, {instead})",
        "fallback": case(("mad > 0", "CAST(NULL AS STRING)"), ("__mean > 0", "'mean_abs_dev'"),
                         default="'constant'")},
        keep=[*keys, "median", "mad", "rows"])


def grouped_outliers(df: DataFrame, column: str, by: list[str],
                     threshold: float = fixed.DEFAULT_THRESHOLD, limit: int = EXACT_LIMIT,
                     floor: int = MIN_HEAVY_ROWS) -> DataFrame:
    """Any numeric column scored within the groups of ``by``: adds ``score`` and ``is_outlier``.

    Null keys are a group like others. Missing and unreadable values have no score; a
    row whose group has no value at all keeps its place with nulls.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    none = [f"__n{i}" for i in range(len(by))]  # null keys join as a mark and a neutral value
    neutral = {k: f"coalesce({ident(c)}, {_neutral(df, c)})" for k, c in zip(keys, by, strict=True)}
    marks = {n: f"{ident(c)} IS NULL" for n, c in zip(none, by, strict=True)}
    value = numeric_value(ident(column), df.schema[column].dataType)
    rows, on = select(df, {**neutral, **marks, "__x": value}), [*keys, *none]
    models = materialize(
        group_models(rows.select(*on, F.col("__x").alias("x")), on, limit, floor), "models")
    told = models.select(*on, F.col("median").alias("__median"), F.col("scale").alias("__scale"),
                         F.col("rows").alias("__rows"))
    known = attach(rows.where("__x IS NOT NULL"), told, on, "__rows", floor)
    score = case(("__scale = 0", "0.0D"),
                 default=f"{literal(fixed.MAD_TO_SIGMA)} * (__x - __median) / __scale")
    scored = select(known, {"score": score}, keep=df.columns)
    missing = select(rows.where("__x IS NULL"), {"score": "CAST(NULL AS DOUBLE)"}, keep=df.columns)
    return select(scored.unionByName(missing), {
        "is_outlier": f"abs(score) > {literal(float(threshold))}"})


def _neutral(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType.simpleString()
    return "''" if kind == "string" else f"CAST('1970-01-01' AS {kind})" \
        if kind in ("date", "timestamp", "timestamp_ntz") else f"CAST(0 AS {kind})"
