"""The worklist: one line per problem a person has to fix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed
from ..functions.sql import case, ident, lookup
from ..functions.text import action_for, cell_text, strip
from ..session import materialize
from .evaluate import ROW_ID, findings
from .resolve import Duplicates, duplicate_findings


def _who(evaluated: DataFrame, fields: dict[str, str]) -> tuple[str, str]:
    """Name and tax id that let somebody find the customer."""
    def shown(field):
        if field not in fields:
            return "CAST(NULL AS STRING)"
        name = fields[field]
        cell = strip(cell_text(ident(name), evaluated.schema[name].dataType))
        return case((f"NOT lower({cell}) IN ('', 'nan')", cell))

    return (
        f"coalesce({shown('company')}, {shown('name')}, '') AS client",
        f"coalesce({shown('tax_id')}, '') AS document")


def build_worklist(
    evaluated: DataFrame,
    fields: dict[str, str],
    duplicates: Duplicates | None = None,
    include_info: bool = False,
    row_id: str = ROW_ID,
    ordered: bool = True,
) -> DataFrame:
    """Findings with customer, cell, instruction and priority.

    Cell findings carry what they need through the same scan; only whole-row
    (duplicate) findings join back to the source, on the unique row number. A sort reads
    its rows twice, so an ordered list is written first.
    """
    client, document = _who(evaluated, fields)
    lines = findings(evaluated, client, document, row_id=row_id)
    if duplicates is not None:
        people = evaluated.selectExpr(f"{ident(row_id)} AS row_id", client, document)
        repeated = duplicate_findings(duplicates).join(people, ROW_ID, "left")
        lines = lines.unionByName(repeated.selectExpr("*", "CAST(NULL AS STRING) AS cell"))
    if not include_info:
        lines = lines.where("severity <> 'info'")

    whole_row = f"`column` = '{fixed.ROW_COLUMN}'"
    current = "coalesce(original, cell, '')"
    made = {
        "Fila en el fichero": "row_id + 2",
        "Cliente": "coalesce(client, '')",
        "NIF o CIF": "coalesce(document, '')",
        "Campo": f"IF({whole_row}, '{fixed.WHOLE_ROW_LABEL}', `column`)",
        "Valor actual": f"IF({whole_row} OR lower({current}) = 'nan', '', {current})",
        "Problema": "message",
        "Sugerencia": "coalesce(proposed, '')",
        "Qué hacer": action_for("rule"),
        "Gravedad": lookup("severity", fixed.SEVERITY_LABEL, "''"),
        "Confianza": "round(confidence, 2)",
        "Regla": "rule",
    }
    out = lines.selectExpr(
        *[f"{made[c]} AS {ident(c)}" for c in fixed.WORKLIST_COLUMNS],
        "2 - level AS __priority", "seq AS __seq")
    if ordered:
        out = materialize(out, "lines").orderBy("__priority", "Fila en el fichero", "Campo", "__seq")
    return out.drop("__priority", "__seq")


def worklist_summary(worklist: DataFrame) -> DataFrame:
    """Totals and the sentence shown above the list."""
    totals = worklist.selectExpr(
        "count(*) AS lines", "count_if(Gravedad = 'Error') AS errors",
        "count_if(Gravedad = 'Revisar') AS to_review",
        "count(DISTINCT `Fila en el fichero`) AS rows")
    sentence = (
        "concat(concat_ws(' y ', IF(errors > 0, concat(errors, ' para corregir'), NULL), "
        "IF(to_review > 0, concat(to_review, ' para revisar'), NULL)), "
        "', repartidas en ', rows, ' filas.')")
    return totals.selectExpr(
        "*", f"IF(lines = 0, 'No hay nada que arreglar.', {sentence}) AS summary")
