"""Impossible and outlying numbers: median, MAD, modified z-score.

A model is a handful of doubles. It is fitted by distributed aggregates and
then becomes literals of the scoring projection: no join, no shuffle, and the
same projection scores a stream.

``exact_medians`` stays exact at any size. While the number of distinct values
fits ``exact_limit`` the built-in ``median`` (a value → count map) does it.
Above that, a bounded quantile sketch brackets the middle rank and plain counts
prove which bracket holds it; each round keeps under a thousandth of the rows.
All columns go through the same rounds, so scans do not grow with their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.sql import case, ident, literal, quote, select
from ..functions.text import strip

EXACT_LIMIT = 100_000
_SKETCH_ACCURACY = 10_000
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class OutlierModel:
    field: str
    column: str
    median: float
    mad: float
    scale: float
    threshold: float
    n_fitted: int
    fallback: str | None = None

    def bounds(self) -> tuple[float, float]:
        if self.scale == 0:
            return self.median, self.median
        reach = self.threshold * self.scale / fixed.MAD_TO_SIGMA
        return self.median - reach, self.median + reach


MODEL_SCHEMA = (
    "field string, column string, median double, mad double, scale double, "
    "threshold double, n_fitted bigint, fallback string, low double, high double"
)


def models_table(spark, models: dict[str, OutlierModel]) -> DataFrame:
    rows = [
        (m.field, m.column, m.median, m.mad, m.scale, m.threshold, m.n_fitted, m.fallback,
         *m.bounds())
        for m in models.values()
    ]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def numeric_value(e: str, dtype: T.DataType) -> str:
    """Cell as a finite double; what cannot be read, NaN and infinities are null."""
    if isinstance(dtype, T.NumericType):
        value = f"CAST({e} AS DOUBLE)"
    else:
        shown = strip(f"CAST({e} AS STRING)")
        value = case((f"{shown} RLIKE {quote(_NUMBER)}", f"try_cast({shown} AS DOUBLE)"))
    return case((f"NOT isnan({value}) AND abs({value}) <> double('Infinity')", value))


def outlier_score(value: str, model: OutlierModel) -> str:
    if model.scale == 0:
        return f"IF({value} IS NOT NULL, 0.0D, NULL)"
    return (
        f"({literal(fixed.MAD_TO_SIGMA)} * ({value} - {literal(model.median)}) "
        f"/ {literal(model.scale)})")


def _row(df: DataFrame, exprs) -> dict:
    """Values of several aggregates, equal ones computed once, by their text."""
    names = {e: f"c{i}" for i, e in enumerate(dict.fromkeys(exprs))}
    if not names:
        return {}
    row = df.selectExpr(*[f"{e} AS {n}" for e, n in names.items()]).head()
    return {e: row[n] for e, n in names.items()}


def _bracket(x: str, share: float = 0.5) -> str:
    """Aggregate of two data values that, up to sketch error, enclose the rank at ``share``."""
    margin = 3.0 / _SKETCH_ACCURACY
    low, high = literal(max(share - margin, 0.0)), literal(min(share + margin, 1.0))
    return f"percentile_approx({x}, array({low}, {high}), {_SKETCH_ACCURACY})"


@dataclass
class _Sought:
    """A 1-based ``rank`` among the ``rows`` values of ``x`` that meet ``within``."""

    x: str
    rank: int
    rows: int
    distinct: int  # estimate of the number of different values
    within: str = "TRUE"
    found: float | None = None

    @property
    def part(self) -> str:
        return self.x if self.within == "TRUE" else f"IF({self.within}, {self.x}, NULL)"

    @property
    def bracket(self) -> str:
        return _bracket(self.part, self.rank / self.rows)

    @property
    def value(self) -> str:
        share = literal((self.rank - 0.5) / self.rows)
        return f"percentile_disc({share}) WITHIN GROUP (ORDER BY {self.part})"

    def stretches(self, low: float, high: float) -> dict[str, tuple[str, str]]:
        """Predicate → counts of the rows and of the different values that meet it, in order."""
        lo, hi = literal(low), literal(high)
        out = {}
        for e in (f"< {lo}", f"= {lo}", f"> {lo} AND {{x}} < {hi}", f"= {hi} AND {{x}} > {lo}",
                  f"> {hi}"):
            where = f"({self.within}) AND {self.x} {e.format(x=self.x)}"
            single = e.startswith("=")
            out[where] = (f"count_if({where})", "1" if single else
                          f"approx_count_distinct(IF({where}, {self.x}, NULL))")
        return out

    def narrow(self, low: float, high: float, counted: dict) -> None:
        for i, (where, (n, d)) in enumerate(self.stretches(low, high).items()):
            if self.rank <= counted[n]:
                self.within, self.rows, self.distinct = where, counted[n], int(counted.get(d, 1))
                if i in (1, 3):
                    self.found = low if i == 1 else high
                return
            self.rank -= counted[n]
        raise RuntimeError("The rank lies beyond the rows.")


def order_statistics(df: DataFrame, sought: list[_Sought], limit: int, first: dict) -> list[str]:
    """Narrow every rank down to at most ``limit`` different values, all in the same scans.

    ``first`` holds brackets that are known already. Returns the aggregates of the values left.
    """
    for _ in range(64):
        wide = [s for s in sought if s.found is None and s.distinct > limit]
        if not wide:
            return [s.value for s in sought if s.found is None]
        ends = first or _row(df, [s.bracket for s in wide])
        ends = [ends[s.x] if first else ends[s.bracket] for s in wide]
        counted = _row(df, [e for s, (lo, hi) in zip(wide, ends, strict=True)
                            for pair in s.stretches(lo, hi).values() for e in pair if e != "1"])
        for s, (lo, hi) in zip(wide, ends, strict=True):
            s.narrow(lo, hi, counted)
        first = {}
    raise RuntimeError("The order statistics did not converge.")


def exact_medians(df: DataFrame, sizes: dict[str, tuple[int, int]], limit: int = EXACT_LIMIT,
                  brackets: dict | None = None) -> dict[str, float]:
    """Medians of several expressions over ``df``, interpolated between the middle two values.

    ``sizes``: expression → (finite values, estimate of the different ones). However many
    expressions there are, they share every scan: brackets, counts and the values inside.
    """
    few = {x: f"median({x})" for x, (_, distinct) in sizes.items() if distinct <= limit}
    middle = {x: [_Sought(x, rank, rows, distinct) for rank in ((rows + 1) // 2, rows // 2 + 1)]
              for x, (rows, distinct) in sizes.items() if x not in few}
    sought = [s for pair in middle.values() for s in pair]
    left = order_statistics(df, sought, limit, brackets or {})
    got = _row(df, [*few.values(), *left])
    out = {x: got[e] for x, e in few.items()}
    for x, pair in middle.items():
        low, high = (got[s.value] if s.found is None else s.found for s in pair)
        out[x] = low if low == high else (low + high) / 2
    return out


def _sizes(df: DataFrame, exprs) -> tuple[dict, dict]:
    """Finite values and estimated different ones of each expression, and its middle's bracket."""
    ask = {e: (f"count({e})", f"approx_count_distinct({e})", _bracket(e)) for e in exprs}
    got = _row(df, [a for three in ask.values() for a in three])
    return ({e: (got[n], got[d]) for e, (n, d, _) in ask.items()},
            {e: got[b] for e, (_, _, b) in ask.items()})


def fit_models(
    df: DataFrame,
    fields: dict[str, str],
    threshold: float = fixed.DEFAULT_THRESHOLD,
    exact_limit: int = EXACT_LIMIT,
) -> dict[str, OutlierModel]:
    """Fit every numeric field of ``fields`` (field → column) together.

    All fields share their scans, which read only those columns: three for the medians and
    three for the deviations, two of each where no field has over ``exact_limit`` values.
    """
    if not fields:
        return {}
    values = {f: numeric_value(ident(c), df.schema[c].dataType) for f, c in fields.items()}
    df = df.selectExpr(*[f"{v} AS v{i}" for i, v in enumerate(values.values())])
    values = {f: f"v{i}" for i, f in enumerate(fields)}
    sizes, brackets = _sizes(df, values.values())
    some = {f: v for f, v in values.items() if sizes[v][0]}
    found = exact_medians(df, {v: sizes[v] for v in some.values()}, exact_limit, brackets)
    centre = {f: found[v] for f, v in some.items()}
    spread = {f: f"abs({v} - {literal(centre[f])})" for f, v in some.items()}
    if any(sizes[v][1] > exact_limit for v in some.values()):
        apart, brackets = _sizes(df, spread.values())
    else:  # there are no more different distances than values
        apart, brackets = {spread[f]: sizes[v] for f, v in some.items()}, {}
    found = exact_medians(df, apart, exact_limit, brackets)
    mads = {f: found[e] for f, e in spread.items()}
    means = _row(df, [f"avg({spread[f]})" for f in some if not mads[f] > 0])

    models = {}
    for field, column in fields.items():
        n = sizes[values[field]][0]
        if not n:
            models[field] = OutlierModel(field, column, 0.0, 0.0, 0.0, threshold, 0, "empty")
        elif mads[field] > 0:
            m = mads[field]
            models[field] = OutlierModel(field, column, centre[field], m, m, threshold, n)
        else:
            dev = means[f"avg({spread[field]})"] * fixed.MEAN_DEV_TO_MAD
            models[field] = OutlierModel(
                field, column, centre[field], 0.0, dev, threshold, n,
                "mean_abs_dev" if dev > 0 else "constant")
    return models


def mad_outliers(
    df: DataFrame, column: str, threshold: float = fixed.DEFAULT_THRESHOLD,
    exact_limit: int = EXACT_LIMIT,
) -> DataFrame:
    """Any numeric column: adds ``score`` and ``is_outlier``; missing values get null."""
    model = fit_models(df, {"value": column}, threshold, exact_limit)["value"]
    value = numeric_value(ident(column), df.schema[column].dataType)
    scored = select(df, {"score": outlier_score(value, model)})
    return select(scored, {"is_outlier": f"abs(score) > {literal(float(threshold))}"})


def domain_message(value: str, field: str) -> str:
    """Message of the broken hard limit, or null when the value is possible."""
    low, high, message = fixed.DOMAIN_RULES[field]
    return case((f"NOT {value} BETWEEN {literal(low)} AND {literal(high)}", quote(message)))
