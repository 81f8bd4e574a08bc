"""Small helpers to write expressions as SQL text.

The library states its expressions as SQL text and hands a whole projection to
Spark at once: the plan is the one the Column API would give, without one
driver-to-JVM call per operator.
"""

from __future__ import annotations

import uuid


def quote(value: str | None) -> str:
    """String literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value) if isinstance(value, int) else quote(value)


def any_of(expr: str, values) -> str:
    return f"{expr} IN (" + ", ".join(literal(v) for v in values) + ")"


def lookup(expr: str, table: dict, default: str = "NULL") -> str:
    """CASE over a fixed table."""
    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def case(*branches: tuple[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"CASE {whens} ELSE {default} END"


def select(df, columns: dict[str, str], keep=True):
    """One projection: the columns of ``df`` (all, or those named) plus new ones."""
    kept = df.columns if keep is True else list(keep or [])
    return df.selectExpr(
        *[ident(c) for c in kept if c not in columns],
        *[f"{e} AS {ident(n)}" for n, e in columns.items()])


def pinned(columns: dict[str, str]) -> str:
    """Columns that filters are not pushed through.

    The optimiser pushes a filter through a projection by copying the
    expressions behind it; over a chain of checks those copies multiply. Columns
    that come out of a (one-row) generator are not copied.
    """
    fields = ", ".join(f"'{n}', {e}" for n, e in columns.items())
    return f"inline(array(named_struct({fields})))"


def staged(df, stages: list[dict[str, str]], final: list[str]):
    """Stacked projections as one statement, so the whole stack is analysed once.

    Each stage may use the columns of the stages before; ``final`` lists what
    comes out.
    """
    spark = df.sparkSession
    view = "tersa_" + uuid.uuid4().hex
    df.createOrReplaceTempView(view)
    source = view
    for stage in stages:
        if stage:
            new = ", ".join(f"{e} AS {ident(n)}" for n, e in stage.items())
            source = f"(SELECT *, {new} FROM {source})"
    try:
        return spark.sql(f"SELECT {', '.join(final)} FROM {source}")
    finally:
        spark.catalog.dropTempView(view)


def replace(df, columns: dict[str, str]):
    """One projection that rewrites some columns in place."""
    return df.selectExpr(*[
        f"{columns[c]} AS {ident(c)}" if c in columns else ident(c) for c in df.columns])
