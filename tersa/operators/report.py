"""Counts, the audit report and its sections."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import literal, quote
from ..functions.text import rule_label, thousands


def counts_by_rule(findings: DataFrame) -> DataFrame:
    """Findings per rule, most frequent first; ties in emission order."""
    return (
        findings.groupBy("rule")
        .agg(F.count("*").alias("count"), F.min(F.struct("seq", "row_id")).alias("first"))
        .orderBy(F.desc("count"), "first").select("rule", "count")
    )


def counts_by_severity(findings: DataFrame) -> DataFrame:
    """All three severities, zero when absent."""
    return findings.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES])


def top_rules(findings: DataFrame, n: int = 12) -> DataFrame:
    return counts_by_rule(findings).limit(n).select(
        "rule", F.expr(rule_label("rule")).alias("label"), "count")


@dataclass(frozen=True)
class CostAssumption:
    """What one wrong value costs, as stated by the caller, and who says so."""

    euros_per_error: float
    source: str


def cost_total(findings: DataFrame, cost: CostAssumption | None) -> DataFrame:
    """Error findings times the given unit cost; no cost means no figure."""
    euros = literal(float(cost.euros_per_error)) if cost else "CAST(NULL AS DOUBLE)"
    return findings.selectExpr("count_if(severity = 'error') AS errors").selectExpr(
        "errors", f"{euros} AS euros_per_error", f"{euros} * errors AS total",
        f"{quote(cost.source if cost else None)} AS cost_source")


_MAPS = ("columns_detected", "counts_by_rule", "counts_by_severity")
# Maps travel as entry lists: a map from a Python dict would lose its order.
_REPORT_ENTRIES = (
    "engine_version string, rows_in bigint, rows_valid bigint, rows_quarantined bigint, "
    "duplicate_groups bigint, duplicate_rows bigint, "
    "columns_detected array<struct<k:string,v:string>>, unmapped_columns array<string>, "
    "counts_by_rule array<struct<k:string,v:bigint>>, "
    "counts_by_severity array<struct<k:string,v:bigint>>, duration_ms bigint"
)


def report_row(evaluated, findings, duplicates, matches, unmapped, quarantine_on, started):
    """The one-row report. What reaches the driver is bounded by the rule list."""
    bar = fixed.LEVEL[quarantine_on]
    rows, valid = evaluated.agg(
        F.count("*"), F.count_if(F.col("__level") < bar)).head()
    rules = (
        findings.groupBy("rule", "severity")
        .agg(F.count("*").alias("n"), F.min(F.struct("seq", "row_id")).alias("first")).collect()
    )
    rules.sort(key=lambda r: (-r["n"], tuple(r["first"])))
    severities = {s: sum(r["n"] for r in rules if r["severity"] == s) for s in fixed.SEVERITIES}
    groups = extra = 0
    if duplicates is not None:
        groups, extra = duplicates.groups.agg(
            F.count("*"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0))).head()
    entries = evaluated.sparkSession.createDataFrame([(
        fixed.ENGINE_VERSION, rows, valid, rows - valid, groups, extra,
        [(m.source, m.canonical) for m in matches], list(unmapped),
        [(r["rule"], r["n"]) for r in rules], list(severities.items()),
        int((time.perf_counter() - started) * 1000),
    )], _REPORT_ENTRIES)
    return entries.selectExpr(*[
        f"map_from_entries({c}) AS {c}" if c in _MAPS else c for c in entries.columns])


QUARANTINE_NOTE = (
    "Una fila en cuarentena contiene al menos un dato inválido de forma demostrable, "
    "como un dígito de control que no cuadra. No se ha eliminado: se ha separado para "
    "que usted decida."
)
_NO_COST_NOTE = (
    "El informe no calcula cuánto dinero supone esto para su empresa: el coste de un dato "
    "incorrecto depende de su operativa. Indique su coste por incidencia y se incorporará "
    "citando su origen."
)
METHOD_NOTE = (
    "Los identificadores fiscales y los IBAN se verifican con su dígito de control oficial: "
    "el resultado es exacto, no probabilístico. Los valores numéricos atípicos se detectan "
    "con la desviación absoluta mediana y el umbral publicado por Iglewicz y Hoaglin (1993). "
    "Los duplicados se proponen, nunca se fusionan automáticamente. Este informe es "
    "reproducible con la versión del motor indicada."
)


def report_sections(
    report: DataFrame, cost: CostAssumption | None = None, top: int = 12
) -> DataFrame:
    """The report as rows ``(position, section, line, label, value, alert, note)``."""
    def entry(label, value, alert="false"):
        return f"named_struct('label', {quote(label)}, 'value', {value}, 'alert', {alert})"

    nothing = "CAST(array() AS ARRAY<STRUCT<label:STRING,value:STRING,alert:BOOLEAN>>)"
    rules = (
        f"transform(slice(map_entries(counts_by_rule), 1, {top}), e -> "
        f"named_struct('label', {rule_label('e.key')}, 'value', {thousands('e.value')}, "
        "'alert', false))")
    more = (
        f"IF(size(counts_by_rule) > {top}, concat('Se muestran los {top} tipos más frecuentes "
        "de ', size(counts_by_rule), '.'), '')")
    columns = (
        "transform(map_entries(columns_detected), e -> "
        "named_struct('label', e.key, 'value', e.value, 'alert', false))")
    left_over = (
        "IF(size(unmapped_columns) > 0, concat('Columnas no reconocidas y conservadas sin "
        "modificar: ', array_join(unmapped_columns, ', ')), '')")
    if cost is None:
        impact, note = nothing, _NO_COST_NOTE
    else:
        unit, errors = literal(float(cost.euros_per_error)), "counts_by_severity['error']"
        impact = "array(" + ", ".join([
            entry("Incidencias demostrables", thousands(errors)),
            entry("Coste por incidencia", f"concat(format_number({unit}, 2), ' EUR')"),
            entry("Total", f"concat(format_number({errors} * {unit}, 2), ' EUR')",
                  f"{errors} > 0"),
        ]) + ")"
        note = (
            f"El coste por incidencia lo ha aportado el cliente. Origen: {cost.source}. "
            "Esta cifra no se ha estimado ni validado.")
    summary = "array(" + ", ".join([
        entry("Filas analizadas", thousands("rows_in")),
        entry("Filas sin incidencias", thousands("rows_valid")),
        entry("Filas en cuarentena", thousands("rows_quarantined"), "rows_quarantined > 0"),
        entry("Grupos de duplicados", thousands("duplicate_groups"), "duplicate_groups > 0"),
        entry("Tiempo de proceso", f"concat({thousands('duration_ms')}, ' ms')"),
    ]) + ")"
    sections = [
        ("Resumen", summary, quote(QUARANTINE_NOTE)),
        ("Incidencias por tipo", rules, more),
        ("Columnas reconocidas", columns, left_over),
        ("Impacto económico", impact, quote(note)),
        ("Metodología", nothing, quote(METHOD_NOTE)),
    ]
    blocks = ", ".join(
        f"named_struct('position', {i}, 'section', {quote(title)}, 'entries', {entries}, "
        f"'note', {text})" for i, (title, entries, text) in enumerate(sections))
    optional = "section IN ('Incidencias por tipo', 'Columnas reconocidas')"
    return (
        report.selectExpr(f"inline(array({blocks}))")
        .where(f"NOT ({optional} AND size(entries) = 0)")
        .selectExpr("position", "section", "posexplode_outer(entries) AS (line, entry)", "note")
        .selectExpr("position", "section", "coalesce(line, 0) AS line", "entry.label AS label",
                    "entry.value AS value", "entry.alert AS alert", "note")
        .orderBy("position", "line")
    )
