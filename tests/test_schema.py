from tersa.operators import schema


def found(spark, rows, ddl, **kw):
    matches, unmapped = schema.detect_schema(spark.createDataFrame(rows, ddl).coalesce(1), **kw)
    return {m.source: m.canonical for m in matches}, unmapped


def test_contents_overrule_headers(spark):
    people = ["Ana Paz", "Luis Gil", "Eva Mar", "Leo Sol", "Iris Rey"]
    rows = [(i + 1, p) for i, p in enumerate(people)]
    got, rest = found(spark, rows, "`Nº Cliente` long, `Persona de contacto` string")
    assert got == {"Persona de contacto": "name"} and rest == ["Nº Cliente"]
    assert found(spark, [(i,) for i in range(101, 106)], "Empresa long")[0] == {}
    assert found(spark, [("A SL",), ("B SL",), ("C SL",)], "Empresa string")[0] == {"Empresa": "company"}
    assert found(spark, [(1,), (2,)], "Empresa long")[0] == {"Empresa": "company"}


def test_unknown_columns(spark):
    got, rest = found(spark, [("a@b.es", "x")], "Email string, Campo_Interno_Raro string")
    assert got == {"Email": "email"} and rest == ["Campo_Interno_Raro"]
    assert found(spark, [(1, "x"), (2, "y")], "aaa long, bbb string")[1] == ["aaa", "bbb"]


def test_contents_only(spark):
    rows = [("a@b.es", "ES9121000418450200051332", "12345678Z", "600123456", "28001")] * 5
    ddl = "f1 string, f2 string, f3 string, f4 string, f5 string"
    got, _ = found(spark, rows, ddl)
    assert list(got.values()) == ["email", "iban", "tax_id", "phone", "postal_code"]


def test_overrides_and_late_values(spark):
    got, _ = found(spark, [("x", "y")], "a string, b string", overrides={"a": "name", "b": "name"})
    assert got == {"a": "name"}
    rows = [(i, None if i < 3000 else f"u{i}@x.es") for i in range(3100)]
    got, _ = found(spark, rows, "k long, zz string", row_id="k")
    assert got == {"zz": "email"}


def test_header_words():
    matches, _ = schema.assign(["Email de contacto principal", "Cliente nombre", "Id_Cliente"])
    assert {m.source: (m.canonical, m.method) for m in matches} == {
        "Email de contacto principal": ("email", "name_contains"),
        "Cliente nombre": ("name", "name"), "Id_Cliente": ("record_id", "name")}
