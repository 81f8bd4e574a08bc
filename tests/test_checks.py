import pytest

from tersa.functions import checks

CASES = {
    "tax_id": [
        *[(v, "tax_id.nif", v[:9]) for v in ("12345678Z", "00000000T", "99999999R")],
        ("12345678-Z", "tax_id.nif", "12345678Z"), ("12.345.678 Z", "tax_id.nif", "12345678Z"),
        ("es12345678z", "tax_id.nif", "12345678Z"),
        *[(v, "tax_id.nif.checksum", v) for v in ("12345678A", "12345678B", "00000000A")],
        *[(v, "tax_id.nie", v) for v in ("X1234567L", "Y1234567X", "Z1234567R")],
        ("X1234567M", "tax_id.nie.checksum", "X1234567M"),
        *[(v, "tax_id.cif", v) for v in ("A58818501", "B65410011", "Q2826000H")],
        ("A58818500", "tax_id.cif.checksum", "A58818500"),
        ("Q28260007", "tax_id.cif.checksum", "Q28260007"),
        *[(v, "tax_id.missing", None) for v in (None, "", "   ", "nan", " N/A ")],
        ("1234567Z", "tax_id.length", "1234567Z"),
        ("123456789012", "tax_id.length", "123456789012"),
        ("ÑÑÑÑÑÑÑÑÑ", "tax_id.format", "ÑÑÑÑÑÑÑÑÑ"),
        *[(f"{n:08d}" + "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23], "tax_id.nif",
           f"{n:08d}" + "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23]) for n in range(0, 920, 37)],
    ],
    "iban": [
        *[(v, "iban.ok", "ES9121000418450200051332") for v in (
            "ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332",
            "es9121000418450200051332", "ES91-2100-0418-4502-0005-1332")],
        *[(v, "iban.ok", v) for v in (
            "DE89370400440532013000", "FR1420041010050500013M02606", "GB29NWBK60161331926819",
            "PT50000201231234567890154")],
        *[(v, "iban.checksum", v) for v in (
            "ES9121000418450200051333", "ES9121000418450200051323")],
        (None, "iban.missing", None), ("", "iban.missing", None),
        ("1234", "iban.format", "1234"), ("ESXX2100041845", "iban.format", "ESXX2100041845"),
        ("ES91210004184502000513", "iban.length", "ES91210004184502000513"),
        # Country outside the list, and far longer than any real account.
        ("BR1800360305000010009795493C1", "iban.ok_unknown_country",
         "BR1800360305000010009795493C1"),
        ("US00" + "1A" * 40, "iban.checksum", "US00" + "1A" * 40),
    ],
    "email": [
        ("iker@empresa.es", "email.ok", "iker@empresa.es"),
        ("a.b+etiqueta@sub.dominio.com", "email.ok", "a.b+etiqueta@sub.dominio.com"),
        ("  IKER@EMPRESA.ES  ", "email.ok", "iker@empresa.es"),
        ("x@a-b--c.es", "email.ok", "x@a-b--c.es"),
        (None, "email.missing", None), ("", "email.missing", None), ("n/a", "email.missing", None),
        *[(v, "email.syntax", v) for v in (
            "no_email.com", "sin@arroba", "dos@@arrobas.com", "x@-a.com", "x@a-.com", "x@a..es")],
        ("test@test.com", "email.placeholder", "test@test.com"),
        ("iker@gmail.con", "email.typo", "iker@gmail.com"),
        ("alguien@mailinator.com", "email.disposable", "alguien@mailinator.com"),
    ],
    "phone": [
        *[(v, "phone.ok", "+34600123456") for v in (
            "600123456", "+34 600 12 34 56", "0034600123456", "600-123-456")],
        ("912345678", "phone.ok", "+34912345678"), (None, "phone.missing", None),
        ("", "phone.missing", None), ("111111111", "phone.placeholder", "111111111"),
        ("666666666", "phone.placeholder", "666666666"),
        ("123456789", "phone.format_es", "123456789"), ("12345", "phone.format_es", "12345"),
        ("60012345678901", "phone.format_es", "60012345678901"),
        ("600+123456", "phone.format_es", "600+123456"),
        ("abc", "phone.empty_after_clean", "abc"),
    ],
    "postal_code": [
        *[(v, "postal_code.ok", v) for v in ("28001", "08001", "01001", "52001")],
        ("1001", "postal_code.lost_zero", "01001"), (None, "postal_code.missing", None),
        ("99999", "postal_code.province", "99999"), ("53001", "postal_code.province", "53001"),
        ("00123", "postal_code.province", "00123"),
        ("123456", "postal_code.length", "123456"), ("0123", "postal_code.length", "0123"),
    ],
}


@pytest.mark.parametrize("kind", CASES)
def test_cases(spark, kind):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES[kind])], "i int, v string")
    got = {r.i: r.verdict for r in checks.validate_column(df, kind, "v").collect()}
    for i, (value, rule, normalized) in enumerate(CASES[kind]):
        assert (got[i].rule, got[i].normalized) == (rule, normalized), value
        assert got[i].ok == (rule in checks.PASSING)


def test_messages_and_confidence(spark):
    df = spark.createDataFrame([("12345678A",), ("1234567Z",), ("A58818500",)], "v string")
    seen = [r.verdict.message for r in checks.validate_column(df, "tax_id", "v").collect()]
    assert seen == [
        "Letra de control incorrecta: se esperaba Z y hay A.",
        "Un identificador fiscal español tiene 9 caracteres, este tiene 8.",
        "Dígito de control incorrecto para la entidad A: se esperaba 1 o A.",
    ]
    mail = spark.createDataFrame([("iker@gmail.con",)], "v string")
    v = checks.validate_column(mail, "email", "v").head().verdict
    assert (v.severity, v.confidence) == ("warning", 0.85)
    assert v.message == "Dominio probablemente mal escrito. Sugerencia: gmail.com."


def test_numeric_columns(spark):
    phones = spark.createDataFrame([(612345678.0,), (float("nan"),), (None,)], "v double")
    rules = [r.verdict.rule for r in checks.validate_column(phones, "phone", "v").collect()]
    assert rules == ["phone.ok", "phone.missing", "phone.missing"]
    codes = spark.createDataFrame([(1001,), (28001,)], "v long")
    out = [r.verdict.normalized for r in checks.validate_column(codes, "postal_code", "v").collect()]
    assert out == ["01001", "28001"]


def test_unknown_check(spark):
    with pytest.raises(ValueError):
        checks.validate_column(spark.createDataFrame([("x",)], "v string"), "passport", "v")


def test_no_python_and_one_scan(spark):
    df = spark.createDataFrame([("x",)], "v string")
    plan = checks.validate_column(df, "email", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Window" not in plan
