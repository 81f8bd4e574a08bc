"""Identifier checks as staged projections.

A check is a list of stages. Each stage is a dict of new columns (SQL text)
computed from the columns of the stage before, so a cleaned value is computed
once and then referenced, not copied into every branch of every CASE.
``apply_checks`` merges stage *k* of all fields into one projection, and all of
them run inside the same whole-stage pipeline.

The stages leave ``__<kind>_rule``, ``_norm`` (canonical text or null) and
``_detail`` (message of a failing value); severity and confidence follow from
the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import fixed
from .sql import any_of, case, ident, lookup, pinned, quote, select, staged
from .text import SPACES, cell_text, is_float, strip, text_of_stripped, text_value

_MISSING = {
    "email": "Email vacío.",
    "phone": "Teléfono vacío.",
    "tax_id": "Identificador fiscal vacío.",
    "iban": "IBAN vacío.",
    "postal_code": "Código postal vacío.",
}
CONFIDENCE = {
    "email.typo": 0.85,
    "email.disposable": 0.95,
    "postal_code.lost_zero": 0.9,
    "iban.ok_unknown_country": 0.8,
}
PASSING = (
    "email.ok", "phone.ok", "tax_id.nif", "tax_id.nie", "tax_id.cif",
    "iban.ok", "iban.ok_unknown_country", "postal_code.ok",
)


def _rest(text: str, start: int) -> str:
    return f"substring({text}, {start})"


# --- tax ids ---------------------------------------------------------------

def clean_id(text: str) -> str:
    joined = f"translate(upper({text}), {quote('-._/' + SPACES)}, '')"
    return case(
        (f"startswith({joined}, 'ES') AND length({joined}) > 9", _rest(joined, 3)),
        default=joined)


def _tax_id(p: str) -> list[dict[str, str]]:
    c, kind, digit, expected = f"{p}_c", f"{p}_kind", f"{p}_digit", f"{p}_letter"
    # Digits 1, 3, 5, 7 are doubled and their figures added; the rest count once.
    terms = []
    for pos in range(1, 8):
        d = f"try_cast(substring({c}, {pos + 1}, 1) AS INT)"
        terms.append(f"({d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if pos % 2 else d)
    number = (
        f"try_cast(CASE {kind} WHEN 'nie' THEN translate(substring({c}, 1, 8), 'XYZ', '012') "
        f"ELSE substring({c}, 1, 8) END AS BIGINT)")
    control, entity = f"substring({c}, 9, 1)", f"substring({c}, 1, 1)"
    letter = f"substring('{fixed.CIF_CONTROL_LETTERS}', {digit} + 1, 1)"
    by_digit, by_letter = f"{control} = CAST({digit} AS STRING)", f"{control} = {letter}"
    cif_ok = case(
        (any_of(entity, fixed.CIF_DIGIT_CONTROL), by_digit),
        (any_of(entity, fixed.CIF_LETTER_CONTROL), by_letter),
        default=f"({by_digit} OR {by_letter})")
    return [
        {c: clean_id(f"{p}_t")},
        {kind: case(
            (f"{c} = ''", "'missing'"),
            (f"length({c}) <> 9", "'length'"),
            (f"{c} RLIKE '^[0-9]{{8}}[A-Z]$'", "'nif'"),
            (f"{c} RLIKE '^[XYZ][0-9]{{7}}[A-Z]$'", "'nie'"),
            (f"{c} RLIKE '^[{fixed.CIF_ENTITY_LETTERS}][0-9]{{7}}[0-9A-J]$'", "'cif'"),
            default="'format'")},
        {expected: case((
            f"{kind} IN ('nif', 'nie')",
            f"substring('{fixed.NIF_LETTERS}', CAST({number} % 23 AS INT) + 1, 1)")),
         digit: case((f"{kind} = 'cif'", f"(10 - ({' + '.join(terms)}) % 10) % 10"))},
        {f"{p}_rule": case(
            (f"{kind} IN ('nif', 'nie')",
             f"concat('tax_id.', {kind}, IF({control} = {expected}, '', '.checksum'))"),
            (f"{kind} = 'cif'", f"IF({cif_ok}, 'tax_id.cif', 'tax_id.cif.checksum')"),
            default=f"concat('tax_id.', {kind})"),
         f"{p}_norm": f"nullif({c}, '')",
         f"{p}_detail": case(
            (f"{kind} = 'length'", "concat('Un identificador fiscal español tiene 9 caracteres, "
                f"este tiene ', length({c}), '.')"),
            (f"{kind} IN ('nif', 'nie')", "concat('Letra de control incorrecta: se esperaba ', "
                f"{expected}, ' y hay ', {control}, '.')"),
            (f"{kind} = 'cif'", "concat('Dígito de control incorrecto para la entidad ', "
                f"{entity}, ': se esperaba ', {digit}, ' o ', {letter}, '.')"),
            default="'No corresponde al formato de un NIF, NIE ni CIF español.'")},
    ]


# --- IBAN ------------------------------------------------------------------

def clean_iban(text: str) -> str:
    return f"translate(upper({text}), {quote('-' + SPACES)}, '')"


def _letters_to_numbers(text: str) -> str:
    for code in range(26):
        text = f"replace({text}, '{chr(65 + code)}', '{code + 10}')"
    return text


def _iban(p: str) -> list[dict[str, str]]:
    c, digits, size, kind = f"{p}_c", f"{p}_digits", f"{p}_len", f"{p}_kind"
    tail = _rest(c, 5)
    # Account first, then country letters as numbers, then the check digits.
    moved = (
        f"concat(CASE WHEN {tail} RLIKE '^[0-9]+$' THEN {tail} "
        f"ELSE {_letters_to_numbers(tail)} END, ascii({c}) - 55, "
        f"ascii(substring({c}, 2, 1)) - 55, substring({c}, 3, 2))")
    # Remainder sixteen digits at a time in 64-bit integers: 18 + 4 * 16 digits
    # cover the 34 characters an IBAN can have. Each step is its own column.
    steps = [{f"{p}_m0": f"try_cast(substring({digits}, 1, 18) AS BIGINT) % 97"}]
    for k in range(4):
        part = f"substring({digits}, {19 + 16 * k}, 16)"
        steps.append({f"{p}_m{k + 1}": case(
            (f"{part} = ''", f"{p}_m{k}"),
            default=f"try_cast(concat({p}_m{k}, {part}) AS BIGINT) % 97")})
    longer = (
        f"aggregate(regexp_extract_all({digits}, '([0-9]{{1,16}})', 1), 0L, "
        "(acc, part) -> try_cast(concat(acc, part) AS BIGINT) % 97)")
    rest = f"{p}_m5"
    return [
        {c: clean_iban(f"{p}_t")},
        {size: lookup(f"substring({c}, 1, 2)", fixed.IBAN_LENGTHS)},
        {kind: case(
            (f"{c} = ''", "'missing'"),
            (f"NOT {c} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$'", "'format'"),
            (f"{size} IS NOT NULL AND length({c}) <> {size}", "'length'"),
            default="'checksum'")},
        {digits: case((f"{kind} = 'checksum'", moved))},
        *steps,
        {rest: case((f"length({digits}) <= 82", f"{p}_m4"), default=longer)},
        {f"{p}_rule": case(
            (f"{kind} <> 'checksum'", f"concat('iban.', {kind})"),
            (f"{rest} <> 1", "'iban.checksum'"),
            (f"{size} IS NULL", "'iban.ok_unknown_country'"), default="'iban.ok'"),
         f"{p}_norm": f"nullif({c}, '')",
         f"{p}_detail": case(
            (f"{kind} = 'format'",
             "'El IBAN debe empezar por dos letras de país y dos dígitos de control.'"),
            (f"{kind} = 'length'", f"concat('Un IBAN de ', substring({c}, 1, 2), ' tiene ', "
                f"{size}, ' caracteres, este tiene ', length({c}), '.')"),
            (f"{rest} <> 1",
             "'Los dígitos de control no cuadran. Hay al menos una cifra mal transcrita.'"),
            default=f"concat('País ', substring({c}, 1, 2), "
                "' fuera de la lista SEPA verificada.')")},
    ]


# --- contact data ----------------------------------------------------------

# A label starts and ends with a letter or digit. Possessive, so linear in time.
_LABEL = "[a-z0-9]++(?:-++[a-z0-9]++)*+"
EMAIL_SYNTAX = rf"^[a-z0-9._%+\-]++@{_LABEL}(?:\.{_LABEL})++$"


def _email(p: str) -> list[dict[str, str]]:
    c, domain, rule = f"{p}_c", f"{p}_domain", f"{p}_rule"
    right = lookup(domain, fixed.DOMAIN_TYPOS)
    return [
        {c: f"lower({p}_t)"},
        {domain: f"substring_index({c}, '@', -1)"},
        {rule: case(
            (f"{c} = ''", "'email.missing'"),
            (any_of(c, fixed.EMAIL_FILLERS), "'email.placeholder'"),
            (f"NOT {c} RLIKE {quote(EMAIL_SYNTAX)}", "'email.syntax'"),
            (any_of(domain, fixed.DOMAIN_TYPOS), "'email.typo'"),
            (any_of(domain, fixed.DISPOSABLE_DOMAINS), "'email.disposable'"),
            default="'email.ok'")},
        {f"{p}_norm": case(
            (f"{rule} = 'email.typo'",
             f"concat(substring({c}, 1, length({c}) - length({domain})), {right})"),
            default=f"nullif({c}, '')"),
         f"{p}_detail": case(
            (f"{rule} = 'email.placeholder'", "'Valor de relleno, no es una dirección real.'"),
            (f"{rule} = 'email.syntax'", "'La dirección no tiene una sintaxis válida.'"),
            (f"{rule} = 'email.typo'", "concat('Dominio probablemente mal escrito. "
                f"Sugerencia: ', {right}, '.')"),
            default="'Dominio de correo desechable.'")},
    ]


def _phone(p: str) -> list[dict[str, str]]:
    raw, kept, dialled, c, rule = (f"{p}_{s}" for s in ("t", "k", "d", "c", "rule"))
    return [
        {kept: f"trim(LEADING '+' FROM regexp_replace({raw}, '[^0-9+]', ''))"},
        {dialled: case((f"startswith({kept}, '00')", _rest(kept, 3)), default=kept)},
        {c: case((f"startswith({dialled}, '34') AND length({dialled}) = 11", _rest(dialled, 3)),
                 default=dialled)},
        {rule: case(
            (f"{raw} = ''", "'phone.missing'"),
            (f"{c} = ''", "'phone.empty_after_clean'"),
            (f"replace({c}, substring({c}, 1, 1), '') = ''", "'phone.placeholder'"),
            (f"NOT {c} RLIKE '^[6789][0-9]{{8}}$'", "'phone.format_es'"),
            default="'phone.ok'")},
        {f"{p}_norm": case(
            (f"{rule} = 'phone.ok'", f"concat('+34', {c})"),
            (f"{rule} = 'phone.empty_after_clean'", raw),
            (f"{rule} <> 'phone.missing'", c)),
         f"{p}_detail": case(
            (f"{rule} = 'phone.empty_after_clean'",
             "'No queda ningún dígito tras limpiar el valor.'"),
            (f"{rule} = 'phone.placeholder'",
             "'Todos los dígitos son iguales, es un valor de relleno.'"),
            default="concat('Un número español tiene 9 dígitos y empieza por 6, 7, 8 o 9. "
                f"Este tiene ', length({c}), ' dígitos.')")},
    ]


def _postal_code(p: str) -> list[dict[str, str]]:
    raw, c, rule = f"{p}_t", f"{p}_c", f"{p}_rule"
    return [
        {c: f"regexp_replace({raw}, '[^0-9]', '')"},
        {rule: case(
            (f"{raw} = ''", "'postal_code.missing'"),
            (f"length({c}) = 4 AND concat('0', substring({c}, 1, 1)) BETWEEN '01' AND '52'",
             "'postal_code.lost_zero'"),
            (f"length({c}) <> 5", "'postal_code.length'"),
            (f"NOT substring({c}, 1, 2) BETWEEN '01' AND '52'", "'postal_code.province'"),
            default="'postal_code.ok'")},
        {f"{p}_norm": case(
            (f"{rule} = 'postal_code.lost_zero'", f"concat('0', {c})"),
            (f"{rule} <> 'postal_code.missing'", c)),
         f"{p}_detail": case(
            (f"{rule} = 'postal_code.lost_zero'",
             "'Falta el cero inicial, probablemente por formato numérico en Excel.'"),
            (f"{rule} = 'postal_code.length'", "concat('Un código postal español tiene 5 "
                f"dígitos, este tiene ', length({c}), '.')"),
            default=f"concat('El código de provincia ', substring({c}, 1, 2), "
                "' no existe en España.')")},
    ]


CHECKS = {
    "email": _email,
    "phone": _phone,
    "tax_id": _tax_id,
    "iban": _iban,
    "postal_code": _postal_code,
}


def apply_checks(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Check several columns at once. ``fields`` maps a check to a column name.

    Adds ``__<kind>_rule``, ``__<kind>_norm`` and ``__<kind>_detail`` per check.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    plans = []
    for kind, name in fields.items():
        cell, dtype, p = ident(name), types[name], f"__{kind}"
        if is_float(dtype) or dtype.typeName() in ("byte", "short", "integer", "long"):
            first = [{f"{p}_t": text_value(cell, dtype)}]
        else:
            first = [{f"{p}_s": strip(f"coalesce({cell_text(cell, dtype)}, '')")},
                     {f"{p}_t": text_of_stripped(f"{p}_s")}]
        plans.append(first + CHECKS[kind](p))
    stages = [
        {k: v for p in plans if step < len(p) for k, v in p[step].items()}
        for step in range(max((len(p) for p in plans), default=0))
    ]
    texts = [f"__{k}_{part}" for k in fields for part in ("norm", "detail")]
    # Rules are what consumers filter on.
    rules = pinned({f"__{k}_rule": f"__{k}_rule" for k in fields})
    return staged(df, stages, [*map(ident, df.columns), *texts, rules])


def passed(kind: str) -> str:
    return any_of(f"__{kind}_rule", [r for r in PASSING if r.startswith(kind + ".")])


def warned(kind: str) -> str:
    own = [r for r in CONFIDENCE if r.startswith(kind + ".")]
    return any_of(f"__{kind}_rule", own) if own else "false"


def severity_of(kind: str) -> str:
    return f"IF({warned(kind)}, 'warning', 'error')"


def confidence_of(kind: str) -> str:
    own = {r: c for r, c in CONFIDENCE.items() if r.startswith(kind + ".")}
    return lookup(f"__{kind}_rule", own, "1.0D") if own else "1.0D"


def message_of(kind: str) -> str:
    silent = [r for r in PASSING if r.startswith(kind + ".") and r not in CONFIDENCE]
    return case(
        (f"__{kind}_rule = '{kind}.missing'", quote(_MISSING[kind])),
        (any_of(f"__{kind}_rule", silent), "''"), default=f"__{kind}_detail")


def verdict(kind: str) -> str:
    """The full verdict of one check, to be used after ``apply_checks``."""
    return (
        f"named_struct('ok', {passed(kind)}, 'normalized', __{kind}_norm, 'rule', __{kind}_rule, "
        f"'severity', {severity_of(kind)}, 'message', {message_of(kind)}, "
        f"'confidence', {confidence_of(kind)})")


def validate_column(df: DataFrame, kind: str, name: str, into: str = "verdict") -> DataFrame:
    """Run one named check over a whole column; adds a verdict struct."""
    if kind not in CHECKS:
        raise ValueError(f"Unknown check: {kind}")
    return select(apply_checks(df, {kind: name}), {into: verdict(kind)}, keep=df.columns)
