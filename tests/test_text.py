import math
import random
import unicodedata

import pytest
from pyspark.sql import types as T

from tersa.functions import privacy, text


def run(spark, fn, values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.selectExpr(f"{fn('v')} AS o", "i").orderBy("i").select("o").collect()]


def test_text_value(spark):
    assert run(spark, text.text_value, [
        "612345678.0", " 612345678 ", "nan", "  ", None, "N/A", "<NA>", "12.50", "-3.000",
        " x "]) == [
        "612345678", "612345678", "", "", "", "", "", "12.50", "-3", "x"]
    doubles = [612345678.0, math.nan, None, 28001.0, 1234.56, 12345678.9, 0.5]
    got = run(spark, lambda e: text.text_value(e, T.DoubleType()), doubles, "v double")
    assert got == ["612345678", "", "", "28001", "1234.56", "12345678.9", "0.5"]
    shown = run(spark, text.float_repr, [150.0, -5000.0, 25_000_000.0, 0.1, 12345678.9], "v double")
    assert shown == ["150.0", "-5000.0", "25000000.0", "0.1", "12345678.9"]


def test_accents_and_keys(spark):
    assert run(spark, text.strip_accents, ["Peña", "Muñoz Gutiérrez", "ÀÉÎÕÜ ç", "é"]) == [
        "Peña", "Muñoz Gutierrez", "AEIOU c", "e"]
    keys = run(spark, text.normalize_key, [
        "Nº Cliente", "1ª Factura", " Razón--Social, S.L. ", None, "a_b"])
    assert keys == ["n cliente", "1 factura", "razon social s l", "", "a_b"]


def test_accents_match_unicode(spark):
    chars = [chr(c) for c in range(0xA0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) <= 2]
    full = ["".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
            if c not in "ñÑ" else c for c in chars]
    pairs = [(c, f) for c, f in zip(chars, full) if len(f) == 1]
    assert run(spark, text.strip_accents, [c for c, _ in pairs]) == [f for _, f in pairs]


def test_unicode_accents_udf(spark):
    df = spark.createDataFrame([("ﬁno Peña",), (None,)], "v string")
    out = df.select(text.strip_accents_unicode(df.v)).collect()
    assert [r[0] for r in out] == ["fino Peña", None]


def scan_company(tokens):
    forms = {f: c for c, fs in text.fixed.LEGAL_FORMS.items() for f in fs}
    out, last, i = [], None, 0
    while i < len(tokens):
        for size in (3, 2, 1):
            code = forms.get(" ".join(tokens[i:i + size]))
            if code:
                last, i = code, i + size
                break
        else:
            out.append(tokens[i])
            i += 1
    return " ".join(out + ([last] if last else []))


def test_company(spark):
    same = run(spark, text.normalize_company, [
        "Talleres Gómez S.L.", "TALLERES GOMEZ SOCIEDAD LIMITADA", "Acme S.A.", "Acme S.L.",
        "Acme S.L.U.", "SL", ""])
    assert same[0] == same[1] == "talleres gomez sl"
    assert same[2:] == ["acme sa", "acme sl", "acme u sl", "sl", ""]
    rng = random.Random(3)
    words = "sl slu s l a sa sociedad limitada anonima civil comunidad de bienes cb coop x yy".split()
    lines = [[rng.choice(words) for _ in range(rng.randint(1, 7))] for _ in range(1500)]
    got = run(spark, text.company_key, [" ".join(t) for t in lines])
    assert got == [scan_company(t) for t in lines]


def test_titles_and_reasons(spark):
    assert run(spark, text.title_case_name, [
        "IKER DE LA TORRE", "maria  del carmen ruiz", "de la o", "ana GARCIA-LOPEZ", None,
        "y de de la"]) == [
        "Iker de la Torre", "Maria del Carmen Ruiz", "De la O", "Ana Garcia-lopez", "",
        "Y de de la"]
    assert run(spark, text.synthetic_reason, [
        None, "x", "Ana 2", "aaaa", "1234", "---", "Test", "N/A", "Ñoño Peña", "aaA a"]) == [
        "Nombre vacío.", "Nombre de un solo carácter.", "El nombre contiene dígitos.",
        "Patrón de tecleo aleatorio o sin letras.", "El nombre contiene dígitos.",
        "Patrón de tecleo aleatorio o sin letras.", "Valor de relleno de formulario.",
        "Valor de relleno de formulario.", None, None]


def test_slug_and_format(spark):
    assert run(spark, text.slugify, ["Asesoría Gómez & Hijos, S.L.", "Ñ", "x" * 80 + "--"]) == [
        "asesoria-gomez-hijos-s-l", "organizacion", "x" * 63]
    assert run(spark, text.format_iban, ["ES9121000418450200051332"]) == [
        "ES91 2100 0418 4502 0005 1332"]
    assert run(spark, text.action_for, ["iban.checksum", "foo.bar"])[1] == "Revisar el dato."
    assert run(spark, text.rule_label, ["iban.checksum", "iban.normalized"])[1] == "iban.normalized"


def test_normalize_columns(spark):
    df = spark.createDataFrame([("  ANA  de PAZ", 600123456.0)], "`Mi Nombre` string, tel double")
    out = text.normalize_columns(df, {"Mi Nombre": "title_case_name", "tel": "text_value"})
    assert tuple(out.head()) == ("Ana de Paz", "600123456")


def test_masks(spark):
    assert run(spark, privacy.mask_email, ["iker.zabala@empresa.com", "ab@x.es", "nada", None]) == [
        "i*********a@empresa.com", "**@x.es", "***", "***"]
    assert run(spark, privacy.mask_phone, ["+34 600 123 456", "12", None]) == [
        "********456", "*********", "*********"]
    assert run(spark, privacy.mask_tax_id, [" 12345678z ", "abc", "abcd"]) == [
        "*****678Z", "*********", "ABCD"]


def test_tokens_equal_hmac(spark):
    import hashlib
    import hmac

    key = "k" * 70
    with pytest.raises(ValueError):
        privacy.Pseudonymizer("short", "org")
    for secret in ("s" * 32, key):
        keyed = privacy.Pseudonymizer(secret, "acme")
        got = run(spark, lambda e: keyed.token(e, "email"), ["iker@x.com", " IKER@X.COM ", "", None])
        want = hmac.new(secret.encode(), b"acme\0email\0iker@x.com", hashlib.sha256).hexdigest()[:32]
        assert got == [want, want, "", ""]
