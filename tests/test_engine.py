import pytest

from tersa import CleanOptions, clean
from tersa.functions.privacy import Pseudonymizer
from tersa.operators import report as rp
from tersa.operators.worklist import worklist_summary

HEAD = ("`Nº Cliente` long, `Razón Social` string, CIF string, `Correo electrónico` string, "
        "Tlf string, `Cuenta bancaria` string, CP string, `Facturación` double")
ROWS = [
    (1, "Talleres Gómez S.L.", "A58818501", "info@gomez.es", "600123456", "ES9121000418450200051332", "28001", 120000.0),
    (2, "TALLERES GOMEZ SOCIEDAD LIMITADA", "A58818501", "INFO@GOMEZ.ES", "+34 600 12 34 56", "ES91 2100 0418 4502 0005 1332", "28001", 120000.0),
    (3, "Panadería  Central   SA", "B65410011", "hola@panaderia.com", "912345678", "ES9121000418450200051333", "08001", 85000.0),
    (4, "Cliente7777", "A58818500", "no_email.com", "111111111", "", "99999", -5000.0),
    (5, "Construcciones Sur SL", "12345678Z", "ventas@gmail.con", "677889900", "ES9121000418450200051332", "28001", 95000.0),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, HEAD).coalesce(1)


@pytest.fixture(scope="module")
def result(table):
    return clean(table)


def test_schema(result):
    assert set(result.fields) == {
        "company", "tax_id", "email", "phone", "iban", "postal_code", "income"}
    assert result.unmapped == ["Nº Cliente"]


def test_findings(result):
    counts = {r.rule: r["count"] for r in result.counts_by_rule().collect()}
    assert counts == {
        "email.normalized": 1, "email.syntax": 1, "email.typo": 1, "phone.normalized": 4,
        "phone.placeholder": 1, "tax_id.cif.checksum": 1, "iban.normalized": 1,
        "iban.checksum": 1, "iban.missing": 1, "postal_code.province": 1,
        "company.formatted": 1, "company.synthetic": 1, "income.impossible": 1,
        "duplicate.group": 2}
    sev = rp.counts_by_severity(result.findings).head()
    assert (sev.error, sev.warning, sev["info"]) == (7, 4, 7)


def test_rows(result, table):
    valid = {r["Nº Cliente"]: r for r in result.valid.collect()}
    assert set(valid) == {1, 2, 5}
    assert {r["Nº Cliente"] for r in result.quarantine.collect()} == {3, 4}
    assert valid[2]["Tlf"] == "+34600123456" and valid[5]["Correo electrónico"] == "ventas@gmail.com"
    assert result.valid.columns == table.columns
    assert result.quality_gate().head().exit_code == 1


def test_group_and_model(result):
    g = result.duplicates.groups.collect()
    assert len(g) == 1
    assert (g[0].key_type, g[0].key_value, g[0].confidence, g[0].survivor_row, g[0].size) == (
        "tax_id", "a58818501", 1.0, 0, 3)
    model = result.models["income"]
    assert (model.median, model.mad) == (95000.0, 25000.0)


def test_report(result):
    row = result.report().head()
    assert (row.rows_in, row.rows_valid, row.rows_quarantined) == (5, 3, 2)
    assert (row.duplicate_groups, row.duplicate_rows) == (1, 2)
    assert row.counts_by_severity == {"info": 7, "warning": 4, "error": 7}
    lines = rp.report_sections(result.report(), rp.CostAssumption(10.0, "Contabilidad")).collect()
    totals = {x.label: x.value for x in lines if x.section == "Impacto económico"}
    assert totals["Total"] == "70.00 EUR"
    assert any(x.label == "CIF con dígito de control incorrecto" for x in lines)
    free = rp.report_sections(result.report()).collect()
    assert not any("EUR" in (x.value or "") for x in free)
    assert rp.cost_total(result.findings, None).head().total is None


def test_modes(table):
    audit = clean(table, CleanOptions(apply_normalizations=False, detect_duplicates=False))
    assert audit.duplicates is None
    kept = {r["Nº Cliente"]: r["Tlf"] for r in audit.valid.collect()}
    assert kept[2] == "+34 600 12 34 56"
    everything = clean(table, CleanOptions(quarantine_on="info", detect_duplicates=False))
    assert everything.valid.count() == 0 and everything.quarantine.count() == 5
    strict = clean(table, CleanOptions(quarantine_on="warning", detect_duplicates=False))
    assert {r["Nº Cliente"] for r in strict.valid.collect()} == {1, 2}
    with pytest.raises(ValueError):
        clean(table, CleanOptions(quarantine_on="fatal"))


def test_protection(table):
    with pytest.raises(ValueError):
        clean(table, CleanOptions(pseudonymize=True))
    keyed = Pseudonymizer("z" * 40, "org")
    hidden = clean(table, CleanOptions(pseudonymize=True, detect_duplicates=False), keyed)
    assert not any("@" in r["Correo electrónico"] for r in hidden.valid.collect())
    assert any("@" in r["Correo electrónico"] for r in hidden.quarantine.collect())
    masked = clean(table, CleanOptions(mask_output=True, detect_duplicates=False))
    assert all("*" in r["Correo electrónico"] and "@" in r["Correo electrónico"]
               for r in masked.valid.collect())


def test_types(spark):
    df = spark.createDataFrame(
        [(1001, 612345678.0, 120.5, 30), (None, 677889900.0, None, 31), (28001, None, 99.0, 32)],
        "CP long, `Teléfono` double, Facturacion double, Edad long").coalesce(1)
    out = clean(df, CleanOptions(quarantine_on="error", detect_duplicates=False))
    rules = {r.rule: r["count"] for r in out.counts_by_rule().collect()}
    assert "phone.format_es" not in rules and rules["phone.missing"] == 1
    assert rules["postal_code.missing"] == 1 and rules["income.missing"] == 1
    rows = out.valid.unionByName(out.quarantine).collect()
    assert sorted((r.CP or "") for r in rows) == ["", "01001", "28001"]
    types = dict(out.valid.dtypes)
    assert types["CP"] == "string" and types["Facturacion"] == "double" and types["Edad"] == "bigint"


def test_empty(spark):
    out = clean(spark.createDataFrame([], "CIF string, Email string"))
    assert out.fields == {} and out.valid.count() == 0 and out.quarantine.count() == 0
    row = out.report().head()
    assert (row.rows_in, row.counts_by_rule) == (0, {})


def test_second_pass_is_quiet(result):
    again = clean(result.valid, CleanOptions(detect_duplicates=False))
    rules = {r.rule for r in again.counts_by_rule().collect()}
    assert not any(r.endswith((".formatted", ".lost_zero", ".normalized")) for r in rules)


def test_worklist(spark):
    df = spark.createDataFrame([
        ("Talleres Gómez SL", "A58818501", "info@gomez.es", "ES9121000418450200051332", "28001"),
        ("Panadería Central SA", "A58818500", "roto", "ES9121000418450200051333", "99999"),
        ("Construcciones Sur SL", "B65410011", "hola@sur.es", "ES9121000418450200051332", "08001"),
        ("TALLERES GOMEZ SOCIEDAD LIMITADA", "A58818501", "INFO@GOMEZ.ES", "ES9121000418450200051332", "28001"),
    ], "`Razón Social` string, CIF string, Correo string, Cuenta string, CP string").coalesce(1)
    out = clean(df)
    lines = out.worklist().collect()
    assert [(r["Fila en el fichero"], r.Campo) for r in lines] == [
        (3, "CIF"), (3, "CP"), (3, "Correo"), (3, "Cuenta"), (4, "Fila completa"),
        (5, "Fila completa")]
    assert all(r.Cliente and r["Qué hacer"] for r in lines)
    assert lines[0]["Valor actual"] == "A58818500" and lines[4]["Valor actual"] == ""
    assert out.worklist(include_info=True).count() == 7
    summary = worklist_summary(out.worklist()).head()
    assert summary.summary == "4 para corregir y 2 para revisar, repartidas en 3 filas."
