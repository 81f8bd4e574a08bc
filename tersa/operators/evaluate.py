"""Row evaluation: every check of a table in one scan, without a shuffle.

``evaluate`` adds to the input
  ``__out_<field>``  corrected value of a recognised column (text),
  ``__f_<field>``    the finding of that cell, or null,
  ``__level``        highest severity of the row, 0 info, 1 warning, 2 error.
Everything after (findings, split, corrections, worklist) is a projection or a
filter of that frame, so column pruning drops what a consumer does not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions import checks, fixed, text
from ..functions.sql import case, ident, literal, lookup, pinned, quote, staged
from .numeric import OutlierModel, numeric_value, outlier_score

ROW_ID = "row_id"

FINDING_COLUMNS = (
    "seq", "row_id", "column", "rule", "severity", "level", "message", "action",
    "original", "proposed", "confidence",
)
_NOTHING = "CAST(NULL AS STRING)"
_EMPTY_SLOT = (
    "CAST(NULL AS STRUCT<seq:INT,column:STRING,rule:STRING,severity:STRING,level:INT,"
    "message:STRING,action:STRING,original:STRING,proposed:STRING,confidence:DOUBLE,cell:STRING>)")


def _cell(df: DataFrame, name: str) -> str:
    return text.cell_text(ident(name), df.schema[name].dataType)


def _finding(field, column, cell, rule, severity, message, action,
             original=_NOTHING, proposed=_NOTHING, confidence="1.0D") -> str:
    level = lookup(severity, fixed.LEVEL, "0")
    return (
        f"named_struct('seq', {fixed.FIELD_SEQ[field]}, 'column', {quote(column)}, "
        f"'rule', {rule}, 'severity', {severity}, 'level', {level}, 'message', {message}, "
        f"'action', {action}, 'original', {original}, 'proposed', {proposed}, "
        f"'confidence', CAST({confidence} AS DOUBLE), 'cell', {cell})")


def _identifier(df, field, name) -> tuple[dict[str, str], str]:
    norm, cell, ok = f"__{field}_norm", _cell(df, name), checks.passed(field)
    changed = f"{norm} IS NOT NULL AND NOT {norm} <=> {cell}"
    severity, confidence = checks.severity_of(field), checks.confidence_of(field)
    failing = _finding(
        field, name, cell, f"__{field}_rule", severity, checks.message_of(field),
        f"IF({norm} IS NOT NULL, 'quarantined', 'kept')", proposed=norm, confidence=confidence)
    tidied = _finding(
        field, name, cell, f"'{field}.normalized'", "'info'",
        "'Valor normalizado a formato canónico.'", "'normalized'", cell, norm)
    dtype = df.schema[name].dataType
    kept = cell if dtype.typeName() == "string" else text.column_as_text(ident(name), dtype)
    # A doubtful value is rewritten only from a confidence of 0.85 upwards.
    doubtful = f"{checks.warned(field)} AND {confidence} >= 0.85D AND {norm} IS NOT NULL"
    return (
        {f"__out_{field}": case(
            (f"{ok} AND {changed}", norm), (f"NOT {ok} AND {doubtful}", norm), default=kept),
         f"__f_{field}": case((f"NOT {ok}", failing), (changed, tidied))},
        case((ok, "0"), (checks.warned(field), "1"), default="2"))


def _name(df, field, name) -> tuple[dict[str, str], str]:
    cell, reason, tidy = _cell(df, name), f"__{field}_reason", f"__{field}_shown"
    changed = f"{tidy} <> '' AND {tidy} <> {cell}"
    synthetic = _finding(
        field, name, cell, f"'{field}.synthetic'", "'warning'", reason, "'kept'", cell)
    formatted = _finding(
        field, name, cell, f"'{field}.formatted'", "'info'",
        "'Capitalización y espacios normalizados.'", "'normalized'", cell, tidy)
    return (
        {f"__out_{field}": case((f"{reason} IS NULL AND {changed}", tidy), default=cell),
         f"__f_{field}": case((f"{reason} IS NOT NULL", synthetic), (changed, formatted))},
        f"IF({reason} IS NOT NULL, 1, 0)")


def _number(df, field, name, model: OutlierModel | None) -> tuple[dict[str, str], str]:
    cell, value = _cell(df, name), f"__{field}_num"
    shown = text.float_repr(value)
    low, high, message = fixed.DOMAIN_RULES[field]
    outside = f"NOT {value} BETWEEN {literal(low)} AND {literal(high)}"
    slots = [
        (f"{value} IS NULL", _finding(
            field, name, cell, f"'{field}.missing'", "'warning'",
            "'Valor numérico ausente o no convertible.'", "'kept'")),
        (outside, _finding(
            field, name, cell, f"'{field}.impossible'", "'error'", quote(message),
            "'quarantined'", shown)),
    ]
    levels = [(f"{value} IS NULL", "1"), (outside, "2")]
    if model is not None and model.scale > 0:
        score = f"abs({outlier_score(value, model)})"
        lower, upper = model.bounds()
        odd = (f"Valor atípico. El rango habitual de esta columna va de {lower:,.0f} "
               f"a {upper:,.0f}.")
        is_odd = f"{score} > {literal(float(model.threshold))}"
        slots.append((is_odd, _finding(
            field, name, cell, f"'{field}.outlier'", "'warning'", quote(odd), "'kept'", shown,
            confidence=f"least(0.99D, {score} / 10)")))
        levels.append((is_odd, "1"))
    return {f"__f_{field}": case(*slots)}, case(*levels, default="0")


def evaluate(
    df: DataFrame, fields: dict[str, str], models: dict[str, OutlierModel] | None = None
) -> DataFrame:
    """Check every recognised column. ``fields`` maps canonical field → column."""
    columns, models = list(df.columns), models or {}
    ids = {f: fields[f] for f in fixed.IDENTIFIER_FIELDS if f in fields}
    checked = checks.apply_checks(df, ids) if ids else df

    tidied, judged = {}, {}
    for field in fixed.NAME_FIELDS:
        if field in fields:
            cell = _cell(df, fields[field])
            tidied[f"__{field}_tidy"] = text.collapse_spaces(f"coalesce({cell}, '')")
            judged[f"__{field}_reason"] = text.reason_of_tidy(f"__{field}_tidy")
            judged[f"__{field}_shown"] = (
                text.title_of_tidy(f"__{field}_tidy") if field == "name"
                else f"__{field}_tidy")
    for field in fixed.NUMERIC_FIELDS:
        if field in fields:
            name = fields[field]
            judged[f"__{field}_num"] = numeric_value(ident(name), df.schema[name].dataType)
    made: dict[str, str] = {}
    levels: list[str] = []
    for field, name in fields.items():
        if field in fixed.IDENTIFIER_FIELDS:
            new, level = _identifier(df, field, name)
        elif field in fixed.NAME_FIELDS:
            new, level = _name(df, field, name)
        elif field in fixed.NUMERIC_FIELDS:
            new, level = _number(df, field, name, models.get(field))
        else:
            continue
        made.update(new)
        levels.append(level)
    worst = f"greatest({', '.join(levels)})" if len(levels) > 1 else (levels or ["0"])[0]
    made["__level"] = f"CAST({worst} AS INT)"
    return staged(checked, [tidied, judged, made], [*map(ident, columns), *made])


def source_columns(evaluated: DataFrame) -> list[str]:
    return [c for c in evaluated.columns if not c.startswith("__")]


def findings(evaluated: DataFrame, *carry: str, row_id: str = ROW_ID) -> DataFrame:
    """One row per finding: a single Generate over a single scan.

    ``carry``: further SQL expressions of the evaluated row to take along.
    """
    slots = [c for c in evaluated.columns if c.startswith("__f_")] or [_EMPTY_SLOT]
    return evaluated.selectExpr(
        f"{ident(row_id)} AS row_id", *carry, f"inline(array({', '.join(slots)}))"
    ).where("rule IS NOT NULL")


def findings_table(evaluated: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    return findings(evaluated, row_id=row_id).selectExpr(*map(ident, FINDING_COLUMNS))


def corrected(evaluated: DataFrame, fields: dict[str, str], apply: bool = True) -> DataFrame:
    """The table with corrections written (or left alone in audit mode) + ``__level``.

    In audit mode identifier columns keep their own type and value.
    """
    by_column = {c: f for f, c in fields.items()}
    present = set(evaluated.columns)
    out = []
    for name in source_columns(evaluated):
        made = f"__out_{by_column.get(name)}"
        out.append(f"{made} AS {ident(name)}" if apply and made in present else ident(name))
    # Both sides of the split filter on the level: see ``pinned``.
    return evaluated.selectExpr(*out, pinned({"__level": "__level"}))


def split(table: DataFrame, quarantine_on: str = "error") -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows; with "info" every row is quarantined."""
    bar = fixed.LEVEL[quarantine_on]
    return (
        table.where(f"__level < {bar}").drop("__level"),
        table.where(f"__level >= {bar}").drop("__level"))


def any_quarantined(evaluated: DataFrame, quarantine_on: str = "error") -> DataFrame:
    """Quality gate: one row, ``exit_code`` 1 when some row is quarantined."""
    hit = evaluated.where(f"__level >= {fixed.LEVEL[quarantine_on]}").select("__level").limit(1)
    return hit.selectExpr("CAST(count(*) AS INT) AS exit_code")


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
