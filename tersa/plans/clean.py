"""The cleaning run: one table in, valid rows, quarantine and findings out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import fixed
from ..functions.privacy import Pseudonymizer
from ..operators import evaluate as ev
from ..operators import numeric, report, resolve, schema, worklist
from ..operators.protection import protect
from ..session import materialize
from ..sources.io import nan_to_null, with_row_id


@dataclass(frozen=True)
class CleanOptions:
    outlier_threshold: float = fixed.DEFAULT_THRESHOLD
    duplicate_threshold: float = fixed.NAME_MATCH_THRESHOLD
    quarantine_on: str = "error"
    apply_normalizations: bool = True
    detect_duplicates: bool = True
    pseudonymize: bool = False
    mask_output: bool = False
    column_overrides: dict[str, str] = field(default_factory=dict)
    # Spark-side choices, none of which changes a result at its default.
    row_id: str | None = None  # unique key column; generated when absent
    protect_quarantine: bool = False
    exact_limit: int = numeric.EXACT_LIMIT
    materialize: bool = True  # write the evaluated frame once for its many consumers


@dataclass
class CleanResult:
    """Lazy frames of one run; nothing large has been computed yet."""

    options: CleanOptions
    fields: dict[str, str]  # canonical field → column
    matches: list[schema.Match]
    unmapped: list[str]
    evaluated: DataFrame
    valid: DataFrame
    quarantine: DataFrame
    findings: DataFrame
    duplicates: resolve.Duplicates | None
    models: dict[str, numeric.OutlierModel]
    started: float

    @property
    def row_id(self) -> str:
        return self.options.row_id or ev.ROW_ID

    def schema_matches(self) -> DataFrame:
        return schema.matches_table(self.evaluated.sparkSession, self.matches)

    def outlier_models(self) -> DataFrame:
        return numeric.models_table(self.evaluated.sparkSession, self.models)

    def counts_by_rule(self) -> DataFrame:
        return report.counts_by_rule(self.findings)

    def worklist(self, include_info: bool = False) -> DataFrame:
        return worklist.build_worklist(
            self.evaluated, self.fields, self.duplicates, include_info, self.row_id)

    def quality_gate(self) -> DataFrame:
        return ev.any_quarantined(self.evaluated, self.options.quarantine_on)

    def report(self) -> DataFrame:
        return report.report_row(
            self.evaluated, self.findings, self.duplicates, self.matches, self.unmapped,
            self.options.quarantine_on, self.started)


def clean(
    df: DataFrame,
    options: CleanOptions | None = None,
    pseudonymizer: Pseudonymizer | None = None,
) -> CleanResult:
    """Recognise the columns of ``df`` and clean it.

    Jobs that run here: the row count per partition (without a key column), the
    content sample, the numeric models and the duplicate groups. Checks,
    corrections, split and protection are left as one projection of the input.
    """
    options, started = options or CleanOptions(), time.perf_counter()
    if options.quarantine_on not in fixed.LEVEL:
        raise ValueError(f"Unknown severity: {options.quarantine_on}")
    if options.pseudonymize and pseudonymizer is None:
        raise ValueError(
            "Se ha pedido seudonimizar sin configurar la clave: falta el Pseudonymizer.")
    source = nan_to_null(df)
    row_id = options.row_id or ev.ROW_ID
    if options.row_id is None and row_id in df.columns:
        raise ValueError(f"The table has a column {row_id}: name it as options.row_id.")

    if df.isEmpty():
        matches, unmapped = [], []
    else:
        matches, unmapped = schema.detect_schema(
            source, options.column_overrides, options.row_id)
    fields = {m.canonical: m.source for m in matches}
    working = source if options.row_id else with_row_id(source, row_id)

    numbers = {f: fields[f] for f in fixed.NUMERIC_FIELDS if f in fields}
    models = numeric.fit_models(
        working, numbers, options.outlier_threshold, options.exact_limit)
    evaluated = ev.evaluate(working, fields, models)
    if options.materialize:
        evaluated = materialize(evaluated, "evaluated")

    duplicates = None
    found = ev.findings_table(evaluated, row_id)
    if options.detect_duplicates and fields:
        duplicates = resolve.find_duplicates(
            working, fields, row_id, options.duplicate_threshold)
        found = ev.union_findings(found, resolve.duplicate_findings(duplicates))

    table = ev.corrected(evaluated, fields, options.apply_normalizations)
    valid, quarantine = ev.split(table, options.quarantine_on)
    guard = {"pseudonyms": options.pseudonymize, "masks": options.mask_output}
    valid = protect(valid, fields, **guard, keyed=pseudonymizer)
    if options.protect_quarantine:
        quarantine = protect(quarantine, fields, **guard, keyed=pseudonymizer)
    if options.row_id is None:
        valid, quarantine = valid.drop(row_id), quarantine.drop(row_id)
    return CleanResult(
        options, fields, matches, unmapped, evaluated, valid, quarantine, found,
        duplicates, models, started)
