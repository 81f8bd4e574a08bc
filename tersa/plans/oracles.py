"""DuckDB statements that compute the registered queries independently.

They read whole tables and follow the published rules (check digits, word lists,
messages), not the plans of the Spark side: character lists instead of integer
chunks, all pairs instead of filtered candidates, recursion instead of stars.
"""

from __future__ import annotations

from ..functions import fixed
from ..operators.report import METHOD_NOTE, QUARANTINE_NOTE
from . import derived
from .queries import AS_OF, COST, DEMO_KEY, FIELDS, PERIOD


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return _q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _bind(sql: str) -> str:
    for table in ("customer", "part", "events", "orders"):
        sql = sql.replace("{" + table + "}", table)
    return sql


CRM = f"crm AS ({_bind(derived.CRM)})"


# --- text ------------------------------------------------------------------

def _tv(e: str) -> str:
    s = f"trim(coalesce({e}, ''))"
    return (
        f"CASE WHEN lower({s}) IN {_in(fixed.NULL_TOKENS)} THEN '' "
        f"WHEN regexp_matches({s}, '^-?[0-9]+[.]0+$') THEN split_part({s}, '.', 1) ELSE {s} END")


def _spaces(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def _plain(e: str) -> str:
    kept = f"replace(replace({e}, 'ñ', '{{n}}'), 'Ñ', '{{N}}')"
    return f"replace(replace(strip_accents({kept}), '{{n}}', 'ñ'), '{{N}}', 'Ñ')"


def _key(e: str) -> str:
    plain = _plain(f"translate(coalesce({e}, ''), 'º°ª', '   ')")
    return f"trim(regexp_replace(lower({plain}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


_FORM_WORDS = sorted(
    (f for fs in fixed.LEGAL_FORMS.values() for f in fs), key=lambda f: -len(f.split()))
_PATTERN = " (" + "|".join(f.replace(" ", "  ") for f in _FORM_WORDS) + ") "


def _company(key: str) -> str:
    # Every word gets its own pair of spaces, so neighbours never share one.
    wide = f"(' ' || replace({key}, ' ', '  ') || ' ')"
    found = f"replace(list_last(regexp_extract_all({wide}, '{_PATTERN}', 1)), '  ', ' ')"
    code = _case(found, {f: c for c, fs in fixed.LEGAL_FORMS.items() for f in fs}, "''")
    rest = _spaces(f"regexp_replace({wide}, '{_PATTERN}', ' ', 'g')")
    return (f"CASE WHEN regexp_matches({wide}, '{_PATTERN}') "
            f"THEN trim({rest} || ' ' || {code}) ELSE {key} END")


def _title(e: str) -> str:
    words = f"string_split(lower({_spaces(f"coalesce({e}, '')")}), ' ')"
    return (
        f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i > 1 AND w IN "
        f"{_in(fixed.NAME_PARTICLES)} THEN w ELSE upper(w[1:1]) || w[2:] END), ' ')")


_FOURS = "|".join(
    f"{c}{{4}}" for c in [*"abcdefghijklmnopqrstuvwxyzáéíóúüñ", "\\.", "-", "_", "/", "\\*"])


def _reason(e: str) -> str:
    t = _spaces(f"coalesce({e}, '')")
    return (
        f"CASE WHEN {t} = '' THEN 'Nombre vacío.' "
        f"WHEN length({t}) < 2 THEN 'Nombre de un solo carácter.' "
        f"WHEN regexp_matches({t}, '[0-9]') THEN 'El nombre contiene dígitos.' "
        f"WHEN regexp_matches(lower({t}), '{_FOURS}') "
        f"OR NOT regexp_matches(lower({t}), '[a-záéíóúüñ]') "
        "THEN 'Patrón de tecleo aleatorio o sin letras.' "
        f"WHEN {_key(t)} IN {_in(fixed.NAME_FILLERS)} THEN 'Valor de relleno de formulario.' END")


def _slug(e: str) -> str:
    plain = f"strip_accents(translate(coalesce({e}, 'None'), 'ñÑ', 'nN'))"
    dashed = f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', '-', 'g'), '-')"
    cut = f"trim({dashed}[1:63], '-')"
    return f"CASE WHEN length({cut}) < 2 THEN 'organizacion' ELSE {cut} END"


def _thousands(e: str, mark: str = ".") -> str:
    return f"replace(format('{{:,}}', CAST({e} AS BIGINT)), ',', '{mark}')"


_NAMES = f"""names AS (
  SELECT 1 AS src, row_id AS id, company AS t FROM crm
  UNION ALL SELECT 2, row_id, name FROM crm
  UNION ALL SELECT 3, c_custkey, c_name FROM customer
  UNION ALL SELECT 4, s_suppkey, s_name FROM supplier)"""


def _text(**columns: str) -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"WITH {CRM}, {_NAMES} SELECT src, id, {made} FROM names"


# --- verdicts --------------------------------------------------------------
# Each CTE: row_id, raw, norm, rule, severity, message, confidence.

_TAX = f"""tax_a AS (SELECT row_id, tax_id AS raw,
    regexp_replace(upper({_tv('tax_id')}), '[\\s\\-._/]', '', 'g') AS c0 FROM crm),
tax_b AS (SELECT *, CASE WHEN c0 LIKE 'ES%' AND length(c0) > 9 THEN c0[3:] ELSE c0 END AS c FROM tax_a),
tax_c AS (SELECT *, CASE WHEN c = '' THEN 'missing' WHEN length(c) <> 9 THEN 'length'
    WHEN regexp_matches(c, '^[0-9]{{8}}[A-Z]$') THEN 'nif'
    WHEN regexp_matches(c, '^[XYZ][0-9]{{7}}[A-Z]$') THEN 'nie'
    WHEN regexp_matches(c, '^[{fixed.CIF_ENTITY_LETTERS}][0-9]{{7}}[0-9A-J]$') THEN 'cif'
    ELSE 'format' END AS kind FROM tax_b),
tax_d AS (SELECT *,
    '{fixed.NIF_LETTERS}'[1 + TRY_CAST(CASE kind WHEN 'nie' THEN translate(c[1:8], 'XYZ', '012') ELSE c[1:8] END AS BIGINT) % 23] AS letter,
    (10 - list_sum(list_transform(range(2, 9), lambda i: CASE WHEN i % 2 = 0
        THEN (TRY_CAST(c[i] AS INT) * 2) // 10 + (TRY_CAST(c[i] AS INT) * 2) % 10
        ELSE TRY_CAST(c[i] AS INT) END)) % 10) % 10 AS digit FROM tax_c),
tax_e AS (SELECT *, '{fixed.CIF_CONTROL_LETTERS}'[CAST(digit AS INT) + 1] AS cl,
    CASE WHEN c[1] IN {_in(fixed.CIF_DIGIT_CONTROL)} THEN c[9] = CAST(CAST(digit AS INT) AS STRING)
         WHEN c[1] IN {_in(fixed.CIF_LETTER_CONTROL)} THEN c[9] = '{fixed.CIF_CONTROL_LETTERS}'[CAST(digit AS INT) + 1]
         ELSE c[9] IN (CAST(CAST(digit AS INT) AS STRING), '{fixed.CIF_CONTROL_LETTERS}'[CAST(digit AS INT) + 1]) END AS cif_ok FROM tax_d),
tax_v AS (SELECT row_id, raw, nullif(c, '') AS norm,
    CASE WHEN kind IN ('nif', 'nie') AND c[9] = letter THEN 'tax_id.' || kind
         WHEN kind IN ('nif', 'nie') THEN 'tax_id.' || kind || '.checksum'
         WHEN kind = 'cif' AND cif_ok THEN 'tax_id.cif' WHEN kind = 'cif' THEN 'tax_id.cif.checksum'
         ELSE 'tax_id.' || kind END AS rule,
    'error' AS severity,
    CASE WHEN kind = 'missing' THEN 'Identificador fiscal vacío.'
         WHEN kind = 'length' THEN 'Un identificador fiscal español tiene 9 caracteres, este tiene ' || length(c) || '.'
         WHEN kind IN ('nif', 'nie') AND c[9] = letter OR kind = 'cif' AND cif_ok THEN ''
         WHEN kind IN ('nif', 'nie') THEN 'Letra de control incorrecta: se esperaba ' || letter || ' y hay ' || c[9] || '.'
         WHEN kind = 'cif' THEN 'Dígito de control incorrecto para la entidad ' || c[1] || ': se esperaba ' || CAST(digit AS INT) || ' o ' || cl || '.'
         ELSE 'No corresponde al formato de un NIF, NIE ni CIF español.' END AS message,
    1.0::DOUBLE AS confidence FROM tax_e)"""

_LENGTHS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in fixed.IBAN_LENGTHS.items()) + ") AS l(country, size)"
_IBAN = f"""iban_a AS (SELECT row_id, iban AS raw, regexp_replace(upper({_tv('iban')}), '[\\s\\-]', '', 'g') AS c FROM crm),
iban_b AS (SELECT a.*, l.size FROM iban_a a LEFT JOIN {_LENGTHS} ON l.country = c[1:2]),
iban_c AS (SELECT *, CASE WHEN c = '' THEN 'missing'
    WHEN NOT regexp_matches(c, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') THEN 'format'
    WHEN size IS NOT NULL AND size <> length(c) THEN 'length' ELSE 'checksum' END AS kind FROM iban_b),
iban_d AS (SELECT *, CASE WHEN kind = 'checksum' THEN list_reduce(
    list_transform(string_split(c[5:] || c[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9'
        THEN CAST(ascii(x) - 48 AS BIGINT) ELSE CAST(ascii(x) - 55 AS BIGINT) END),
    lambda acc, d: CASE WHEN d < 10 THEN (acc * 10 + d) % 97 ELSE (acc * 100 + d) % 97 END) END AS rest FROM iban_c),
iban_v AS (SELECT row_id, raw, nullif(c, '') AS norm,
    CASE WHEN kind <> 'checksum' THEN 'iban.' || kind WHEN rest <> 1 THEN 'iban.checksum'
         WHEN size IS NULL THEN 'iban.ok_unknown_country' ELSE 'iban.ok' END AS rule,
    CASE WHEN kind = 'checksum' AND rest = 1 AND size IS NULL THEN 'warning' ELSE 'error' END AS severity,
    CASE WHEN kind = 'missing' THEN 'IBAN vacío.'
         WHEN kind = 'format' THEN 'El IBAN debe empezar por dos letras de país y dos dígitos de control.'
         WHEN kind = 'length' THEN 'Un IBAN de ' || c[1:2] || ' tiene ' || size || ' caracteres, este tiene ' || length(c) || '.'
         WHEN rest <> 1 THEN 'Los dígitos de control no cuadran. Hay al menos una cifra mal transcrita.'
         WHEN size IS NULL THEN 'País ' || c[1:2] || ' fuera de la lista SEPA verificada.' ELSE '' END AS message,
    CASE WHEN kind = 'checksum' AND rest = 1 AND size IS NULL THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM iban_d)"""

_SYNTAX = ("^[a-z0-9._%+\\-]+@[a-z0-9]([a-z0-9\\-]*[a-z0-9])?"
           "(\\.[a-z0-9]([a-z0-9\\-]*[a-z0-9])?)+$")


def _email(source: str, name: str = "email", key: str = "row_id") -> str:
    right = _case("domain", fixed.DOMAIN_TYPOS)
    return f"""email_a AS (SELECT {key}, {name} AS raw, lower({_tv(name)}) AS c FROM {source}),
email_b AS (SELECT *, regexp_extract(c, '[^@]*$') AS domain FROM email_a),
email_c AS (SELECT *, CASE WHEN c = '' THEN 'email.missing'
    WHEN c IN {_in(fixed.EMAIL_FILLERS)} THEN 'email.placeholder'
    WHEN NOT regexp_matches(c, '{_SYNTAX}') THEN 'email.syntax'
    WHEN domain IN {_in(fixed.DOMAIN_TYPOS)} THEN 'email.typo'
    WHEN domain IN {_in(fixed.DISPOSABLE_DOMAINS)} THEN 'email.disposable' ELSE 'email.ok' END AS rule FROM email_b),
email_v AS (SELECT {key}, raw,
    CASE WHEN rule = 'email.typo' THEN c[1:length(c) - length(domain)] || {right} ELSE nullif(c, '') END AS norm, rule,
    CASE WHEN rule IN ('email.typo', 'email.disposable') THEN 'warning' ELSE 'error' END AS severity,
    CASE rule WHEN 'email.missing' THEN 'Email vacío.'
      WHEN 'email.placeholder' THEN 'Valor de relleno, no es una dirección real.'
      WHEN 'email.syntax' THEN 'La dirección no tiene una sintaxis válida.'
      WHEN 'email.typo' THEN 'Dominio probablemente mal escrito. Sugerencia: ' || {right} || '.'
      WHEN 'email.disposable' THEN 'Dominio de correo desechable.' ELSE '' END AS message,
    CASE rule WHEN 'email.typo' THEN 0.85::DOUBLE WHEN 'email.disposable' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM email_c)"""


_PHONE = f"""phone_a AS (SELECT row_id, phone AS raw, {_tv('phone')} AS t FROM crm),
phone_b AS (SELECT *, regexp_replace(regexp_replace(t, '[^0-9+]', '', 'g'), '^\\++', '') AS k FROM phone_a),
phone_c AS (SELECT *, regexp_replace(k, '^00', '') AS d FROM phone_b),
phone_d AS (SELECT *, CASE WHEN d LIKE '34%' AND length(d) = 11 THEN d[3:] ELSE d END AS c FROM phone_c),
phone_e AS (SELECT *, CASE WHEN t = '' THEN 'phone.missing' WHEN c = '' THEN 'phone.empty_after_clean'
    WHEN len(list_distinct(string_split(c, ''))) = 1 THEN 'phone.placeholder'
    WHEN NOT regexp_matches(c, '^[6789][0-9]{{8}}$') THEN 'phone.format_es' ELSE 'phone.ok' END AS rule FROM phone_d),
phone_v AS (SELECT row_id, raw,
    CASE rule WHEN 'phone.ok' THEN '+34' || c WHEN 'phone.missing' THEN NULL WHEN 'phone.empty_after_clean' THEN t ELSE c END AS norm,
    rule, 'error' AS severity,
    CASE rule WHEN 'phone.missing' THEN 'Teléfono vacío.'
      WHEN 'phone.empty_after_clean' THEN 'No queda ningún dígito tras limpiar el valor.'
      WHEN 'phone.placeholder' THEN 'Todos los dígitos son iguales, es un valor de relleno.'
      WHEN 'phone.format_es' THEN 'Un número español tiene 9 dígitos y empieza por 6, 7, 8 o 9. Este tiene ' || length(c) || ' dígitos.'
      ELSE '' END AS message, 1.0::DOUBLE AS confidence FROM phone_e)"""

_POSTAL = f"""postal_a AS (SELECT row_id, postal_code AS raw, {_tv('postal_code')} AS t FROM crm),
postal_b AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS c FROM postal_a),
postal_c AS (SELECT *, CASE WHEN t = '' THEN 'missing'
    WHEN length(c) = 4 AND TRY_CAST(c[1] AS INT) BETWEEN 1 AND 9 THEN 'lost_zero'
    WHEN length(c) <> 5 THEN 'length'
    WHEN NOT TRY_CAST(c[1:2] AS INT) BETWEEN 1 AND 52 THEN 'province' ELSE 'ok' END AS kind FROM postal_b),
postal_v AS (SELECT row_id, raw, CASE kind WHEN 'lost_zero' THEN '0' || c WHEN 'missing' THEN NULL ELSE c END AS norm,
    'postal_code.' || kind AS rule, CASE kind WHEN 'lost_zero' THEN 'warning' ELSE 'error' END AS severity,
    CASE kind WHEN 'missing' THEN 'Código postal vacío.'
      WHEN 'lost_zero' THEN 'Falta el cero inicial, probablemente por formato numérico en Excel.'
      WHEN 'length' THEN 'Un código postal español tiene 5 dígitos, este tiene ' || length(c) || '.'
      WHEN 'province' THEN 'El código de provincia ' || c[1:2] || ' no existe en España.' ELSE '' END AS message,
    CASE kind WHEN 'lost_zero' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM postal_c)"""

_PASS = ("rule IN ('email.ok', 'phone.ok', 'tax_id.nif', 'tax_id.nie', 'tax_id.cif', 'iban.ok', "
         "'iban.ok_unknown_country', 'postal_code.ok')")


def _verdicts(block: str, view: str) -> str:
    return (f"WITH {CRM}, {block} SELECT row_id, {_PASS} AS ok, norm AS normalized, rule, "
            f"severity, message, confidence FROM {view}")


# --- findings --------------------------------------------------------------

def _float(e: str) -> str:
    return f"CAST(CAST({e} AS DOUBLE) AS STRING)"


def _identifier_findings(seq: int, field: str, view: str) -> str:
    return f"""SELECT {seq} AS seq, row_id, '{field}' AS "column",
    CASE WHEN {_PASS} THEN '{field}.normalized' ELSE rule END AS rule,
    CASE WHEN {_PASS} THEN 'info' ELSE severity END AS severity,
    CASE WHEN {_PASS} THEN 'Valor normalizado a formato canónico.' ELSE message END AS message,
    CASE WHEN {_PASS} THEN 'normalized' WHEN norm IS NULL THEN 'kept' ELSE 'quarantined' END AS action,
    CASE WHEN {_PASS} THEN raw END AS original, norm AS proposed,
    CASE WHEN {_PASS} THEN 1.0::DOUBLE ELSE confidence END AS confidence, raw AS cell
    FROM {view} WHERE NOT {_PASS} OR norm IS DISTINCT FROM raw"""


def _name_findings(seq: int, field: str, tidy: str) -> str:
    return f"""SELECT {seq}, row_id, '{field}', CASE WHEN why IS NULL THEN '{field}.formatted' ELSE '{field}.synthetic' END,
    CASE WHEN why IS NULL THEN 'info' ELSE 'warning' END,
    coalesce(why, 'Capitalización y espacios normalizados.'),
    CASE WHEN why IS NULL THEN 'normalized' ELSE 'kept' END, {field},
    CASE WHEN why IS NULL THEN tidy END, 1.0::DOUBLE, {field}
    FROM (SELECT row_id, {field}, {_reason(field)} AS why, {tidy} AS tidy FROM crm)
    WHERE why IS NOT NULL OR (tidy <> '' AND tidy <> {field})"""


def _number_findings(seq: int, field: str, kind: str) -> str:
    low, high, message = fixed.DOMAIN_RULES[field]
    cell = f"CAST({field} AS STRING)" if kind == "int" else _float(field)
    return f"""SELECT {seq}, row_id, '{field}',
    CASE WHEN {field} IS NULL THEN '{field}.missing' WHEN NOT {field} BETWEEN {low} AND {high} THEN '{field}.impossible' ELSE '{field}.outlier' END,
    CASE WHEN {field} IS NOT NULL AND NOT {field} BETWEEN {low} AND {high} THEN 'error' ELSE 'warning' END,
    CASE WHEN {field} IS NULL THEN 'Valor numérico ausente o no convertible.'
         WHEN NOT {field} BETWEEN {low} AND {high} THEN '{message}'
         ELSE 'Valor atípico. El rango habitual de esta columna va de ' || format('{{:,.0f}}', med - reach) || ' a ' || format('{{:,.0f}}', med + reach) || '.' END,
    CASE WHEN {field} IS NOT NULL AND NOT {field} BETWEEN {low} AND {high} THEN 'quarantined' ELSE 'kept' END,
    CASE WHEN {field} IS NOT NULL THEN {_float(field)} END, NULL,
    CASE WHEN {field} BETWEEN {low} AND {high} THEN least(0.99, abs(score) / 10) ELSE 1.0 END::DOUBLE, {cell}
    FROM (SELECT crm.*, med, 3.5 * mad / 0.6745 AS reach, 0.6745 * ({field} - med) / mad AS score FROM crm,
      (SELECT median({field}::DOUBLE) AS med, mad({field}::DOUBLE) AS mad FROM crm) AS model)
    WHERE {field} IS NULL OR NOT {field} BETWEEN {low} AND {high} OR abs(score) > 3.5"""


_CHECKED = ", ".join([_email("crm"), _PHONE, _TAX, _IBAN, _POSTAL])
_FOUND = f"""found AS (
  {_identifier_findings(0, 'email', 'email_v')}
  UNION ALL {_identifier_findings(1, 'phone', 'phone_v')}
  UNION ALL {_identifier_findings(2, 'tax_id', 'tax_v')}
  UNION ALL {_identifier_findings(3, 'iban', 'iban_v')}
  UNION ALL {_identifier_findings(4, 'postal_code', 'postal_v')}
  UNION ALL {_name_findings(5, 'name', _title('name'))}
  UNION ALL {_name_findings(6, 'company', _spaces("coalesce(company, '')"))}
  UNION ALL {_number_findings(7, 'age', 'int')}
  UNION ALL {_number_findings(8, 'income', 'double')}),
levels AS (SELECT crm.row_id, coalesce(max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END), 0) AS level
  FROM crm LEFT JOIN found USING (row_id) GROUP BY crm.row_id)"""
_RUN = f"WITH RECURSIVE {CRM}, {_CHECKED}, {_FOUND}"
_LEVEL = _case("severity", fixed.LEVEL)


def _cleaned(apply: bool) -> str:
    if not apply:
        return f"WITH {CRM} SELECT row_id, company, name, tax_id, iban, email, phone, postal_code, age, round(income, 4) AS income FROM crm"
    fixes = ", ".join(
        f"coalesce(max(proposed) FILTER (WHERE \"column\" = '{c}' AND (severity = 'info' OR "
        f"(severity = 'warning' AND confidence >= 0.85 AND proposed IS NOT NULL))), any_value(crm.{c})) AS {c}"
        for c in ("company", "name", "tax_id", "iban", "email", "phone", "postal_code"))
    return (f"{_RUN} SELECT crm.row_id, {fixes}, any_value(age) AS age, round(any_value(income), 4) AS income "
            "FROM crm LEFT JOIN found USING (row_id) GROUP BY crm.row_id")


# --- numbers ---------------------------------------------------------------

def _model(field: str, table: str, column: str) -> str:
    return f"""SELECT '{field}' AS field, count(x) AS n_fitted, median(x) AS median, mad(x) AS mad,
      (SELECT avg(abs(x - m)) FROM (SELECT {column}::DOUBLE AS x FROM {table}), (SELECT median({column}::DOUBLE) AS m FROM {table})) AS dev
      FROM (SELECT {column}::DOUBLE AS x FROM {table})"""


_MODELS = " UNION ALL ".join([
    _model("c_acctbal", "customer", "c_acctbal"), _model("o_totalprice", "orders", "o_totalprice"),
    _model("l_extendedprice", "lineitem", "l_extendedprice"),
    _model("l_discount", "lineitem", "l_discount"), _model("value", "events", "value"),
    _model("age", "crm", "age"), _model("income", "crm", "income")])
_OUTLIER_MODEL = f"""WITH {CRM}, m AS ({_MODELS}),
s AS (SELECT *, CASE WHEN mad > 0 THEN mad ELSE dev * 1.253314 END AS scale,
  CASE WHEN mad > 0 THEN NULL WHEN dev > 0 THEN 'mean_abs_dev' ELSE 'constant' END AS fallback FROM m)
SELECT field, n_fitted, fallback, round(median, 6) AS median, round(mad, 6) AS mad, round(scale, 6) AS scale,
  round(median - 3.5 * scale / 0.6745, 6) AS low, round(median + 3.5 * scale / 0.6745, 6) AS high FROM s"""


def _flags(table: str, keys: str, column: str) -> str:
    return (f"SELECT {keys}, round(0.6745 * ({column} - med) / mad, 6) AS score, "
            f"abs(0.6745 * ({column} - med) / mad) > 3.5 AS is_outlier FROM {table}, "
            f"(SELECT median({column}) AS med, mad({column}) AS mad FROM {table})")


def _grouped_flags(table: str, keys: str, column: str, by: str) -> str:
    return f"""WITH c AS (SELECT {by}, median({column}) AS med FROM {table} GROUP BY {by}),
d AS (SELECT {keys}, {by}, {column} - med AS dev FROM {table} JOIN c USING ({by})),
m AS (SELECT {by}, median(abs(dev)) AS mad, avg(abs(dev)) * 1.253314 AS instead FROM d GROUP BY {by}),
s AS (SELECT *, CASE WHEN mad > 0 THEN mad ELSE instead END AS scale FROM d JOIN m USING ({by})),
t AS (SELECT *, CASE WHEN dev IS NULL THEN NULL WHEN scale = 0 THEN 0.0 ELSE 0.6745 * dev / scale END AS z FROM s)
SELECT {keys}, round(z, 6) AS score, abs(z) > 3.5 AS is_outlier FROM t"""


# --- duplicates ------------------------------------------------------------

_USABLE = "lower(trim(coalesce(v, ''))) NOT IN " + _in(fixed.NULL_TOKENS)
_EXACT_KEYS = f"""cells AS (
  SELECT row_id, 'tax_id' AS key_type, tax_id AS v FROM crm UNION ALL SELECT row_id, 'iban', iban FROM crm
  UNION ALL SELECT row_id, 'email', email FROM crm UNION ALL SELECT row_id, 'phone', phone FROM crm),
keyed AS (SELECT row_id, key_type, lower(trim(v)) AS key FROM cells WHERE {_USABLE})"""
_WEIGHT = _case("key_type", fixed.KEY_CONFIDENCE)
_CHAIN = f"""chain AS (SELECT lag(row_id) OVER w AS i, row_id AS j, key_type, key AS key_value, ({_WEIGHT})::DOUBLE AS confidence, 0 AS phase
  FROM keyed WINDOW w AS (PARTITION BY key_type, key ORDER BY row_id)),
links0 AS (SELECT * FROM chain WHERE i IS NOT NULL)"""
_NAME_KEY = f"""plain_keys AS (SELECT row_id, coalesce(nullif(substr(coalesce(postal_code, ''), 1, 5), ''), '_') AS block, {_key('company')} AS k FROM crm),
name_keys AS (SELECT row_id, block, {_company('k')} AS key FROM plain_keys)"""
# Every pair of rows of a block with the same key; near keys do not occur in crm
# (checked by the similarity oracle below on a table where they do).
_NAME_LINKS = """sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS entries FROM name_keys WHERE key <> ''),
name_links AS (SELECT a.row_id AS i, b.row_id AS j, 'name' AS key_type, a.key AS key_value, 0.9::DOUBLE AS confidence, 1 AS phase
  FROM sized a JOIN sized b ON a.block = b.block AND a.key = b.key AND a.row_id < b.row_id)"""
_COMPONENTS = """both_ways AS (SELECT i AS a, j AS b FROM links UNION SELECT j, i FROM links),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
labels AS (SELECT a AS row_id, min(b) AS group_id FROM reach GROUP BY a),
ranked AS (SELECT group_id, key_type, key_value, confidence,
  row_number() OVER (PARTITION BY group_id ORDER BY confidence DESC, i, j, phase) AS rank
  FROM links JOIN labels ON labels.row_id = links.i),
sizes AS (SELECT group_id, CAST(count(*) AS INT) AS size FROM labels GROUP BY group_id),
groups AS (SELECT group_id, key_type, key_value, confidence, group_id AS survivor_row, size FROM ranked JOIN sizes USING (group_id) WHERE rank = 1)"""
_EXACT_GROUPS = f"WITH RECURSIVE {CRM}, {_EXACT_KEYS}, {_CHAIN}, links AS (SELECT * FROM links0), {_COMPONENTS}"
_FULL_PARTS = (f"{_EXACT_KEYS}, {_CHAIN}, {_NAME_KEY}, {_NAME_LINKS}, "
               f"links AS (SELECT * FROM links0 UNION ALL SELECT * FROM name_links), {_COMPONENTS}")
_FULL_GROUPS = f"WITH RECURSIVE {CRM}, {_FULL_PARTS}"
_DUPLICATE_LINES = """repeats AS (SELECT 9 AS seq, labels.row_id, '__row__' AS "column", 'duplicate.group' AS rule, 'warning' AS severity,
  'Duplicado de la fila ' || labels.group_id || ' por coincidencia de ' || key_type || '.' AS message, 'kept' AS action,
  NULL::VARCHAR AS original, NULL::VARCHAR AS proposed, confidence, NULL::VARCHAR AS cell
  FROM labels JOIN groups USING (group_id) WHERE labels.row_id <> labels.group_id)"""

# Similarity by definition: all pairs of keys of a block, and for each pair the
# longest common block (earliest in the first text, then in the second), then
# both sides of it, until nothing is shared.
def _similar(name: str = "") -> str:
    return f"""names AS ({_bind(derived.NAMES)}),
plain_keys AS (SELECT row_id, postal_code AS block, {_key('company')} AS k FROM names),
name_keys AS (SELECT row_id, block, {name or _company('k')} AS key FROM plain_keys),
distinct_keys AS (SELECT block, key, min(row_id) AS lo, max(row_id) AS hi FROM name_keys GROUP BY block, key),
key_pairs AS (SELECT a.block, a.key AS key_a, b.key AS key_b, a.lo AS lo_a, a.hi AS hi_a, b.lo AS lo_b, b.hi AS hi_b
  FROM distinct_keys a JOIN distinct_keys b ON a.block = b.block AND a.key < b.key
  WHERE abs(length(a.key) - length(b.key)) / greatest(length(a.key), length(b.key)) <= 0.2
    AND levenshtein(a.key, b.key) <= 0.08 * (length(a.key) + length(b.key)) + 1e-9),
texts AS (SELECT key_a AS x, key_b AS y FROM key_pairs WHERE lo_a < hi_b
  UNION SELECT key_b, key_a FROM key_pairs WHERE lo_b < hi_a),
spans AS (
  SELECT x, y, 1 AS alo, length(x) + 1 AS ahi, 1 AS blo, length(y) + 1 AS bhi, 0 AS size FROM texts
  UNION ALL
  SELECT x, y, side.alo, side.ahi, side.blo, side.bhi, side.size FROM (
    SELECT x, y, unnest([
      {{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'size': n}},
      {{'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi, 'size': 0}}]) AS side
    FROM (SELECT x, y, alo, ahi, blo, bhi, best.n AS n, -best.i AS i, -best.j AS j FROM (
      SELECT x, y, alo, ahi, blo, bhi, list_max(list_transform(range(alo, ahi), lambda i: list_max(
        list_transform(range(blo, bhi), lambda j: {{'n': CASE WHEN x[i] = y[j] THEN
          coalesce(list_position(list_transform(range(1, least(ahi - i, bhi - j)), lambda k: x[i + k] = y[j + k]), false), least(ahi - i, bhi - j)) ELSE 0 END,
          'i': -i, 'j': -j}})))) AS best
      FROM spans WHERE ahi > alo AND bhi > blo) WHERE best.n > 0))),
ratios AS (SELECT x, y, 2.0 * sum(size) / (length(x) + length(y)) AS ratio FROM spans GROUP BY x, y),
scored AS (SELECT p.*, greatest(CASE WHEN lo_a < hi_b THEN f.ratio ELSE 0 END, CASE WHEN lo_b < hi_a THEN b.ratio ELSE 0 END)::DOUBLE AS score
  FROM key_pairs p LEFT JOIN ratios f ON f.x = key_a AND f.y = key_b LEFT JOIN ratios b ON b.x = key_b AND b.y = key_a),
pairs AS (SELECT * FROM scored WHERE score >= 0.92)"""


# --- protection ------------------------------------------------------------

def _token(field: str) -> str:
    key = DEMO_KEY.encode()
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    scope = (b"org_1\0" + field.encode() + b"\0").hex()
    text = f"lower(trim({_tv(field)}))"
    inner = f"sha256(unhex('{pads[0]}{scope}' || hex(encode({text}))))"
    return (f"CASE WHEN {text} = '' THEN '' ELSE "
            f"sha256(unhex('{pads[1]}' || {inner}))[1:32] END AS {field}")


def _stars(text: str, visible: int) -> str:
    return (f"CASE WHEN length({text}) < 4 THEN '*********' ELSE "
            f"repeat('*', length({text}) - {visible}) || right({text}, {visible}) END")


def _mask_email(e: str) -> str:
    s = f"trim(coalesce({e}, ''))"
    domain = f"regexp_extract({s}, '[^@]*$')"
    box = f"{s}[1:length({s}) - length({domain}) - 1]"
    return (f"CASE WHEN NOT contains({s}, '@') THEN '***' WHEN length({box}) <= 2 "
            f"THEN repeat('*', length({box})) || '@' || {domain} ELSE {box}[1] || "
            f"repeat('*', length({box}) - 2) || right({box}, 1) || '@' || {domain} END")


# --- worklist --------------------------------------------------------------

_WHO = """coalesce(nullif(trim(company), ''), nullif(trim(name), ''), '') AS client, trim(tax_id) AS document"""


def _lines(source: str) -> str:
    action = _case("split_part(rule, '.', 1)", fixed.ACTION_TEXT, _q(fixed.DEFAULT_ACTION_TEXT))
    return f"""SELECT f.row_id + 2 AS line, client, document,
  CASE WHEN "column" = '__row__' THEN 'Fila completa' ELSE "column" END AS field,
  CASE WHEN "column" = '__row__' THEN '' ELSE coalesce(original, cell, '') END AS current_value,
  message AS problem, coalesce(proposed, '') AS suggestion, {action} AS instruction,
  {_case('severity', fixed.SEVERITY_LABEL)} AS severity, round(confidence, 2) AS confidence, rule
  FROM ({source}) f JOIN (SELECT row_id, {_WHO} FROM crm) USING (row_id)"""


# --- account tables --------------------------------------------------------

_BILLING = f"""billing AS (SELECT * FROM ({_bind(derived.BILLING)})
  WHERE type IN {_in((fixed.CHECKOUT_EVENT, fixed.PAYMENT_FAILED_EVENT, *fixed.SUBSCRIPTION_EVENTS))}),
told AS (SELECT *, coalesce(org_id, client_reference_id) AS named,
  (type = '{fixed.CHECKOUT_EVENT}' AND mode = 'subscription' OR type IN {_in(fixed.SUBSCRIPTION_EVENTS)}) AS writes FROM billing),
links AS (SELECT ts, event_id, named AS org, customer FROM told WHERE writes AND named IS NOT NULL AND customer IS NOT NULL),
asked AS (SELECT event_id, ts, customer FROM told WHERE named IS NULL AND customer IS NOT NULL),
cand AS (SELECT a.event_id, a.ts, a.customer, arg_max(l.org, (l.ts, l.event_id)) AS org
  FROM asked a JOIN links l ON l.customer = a.customer AND (l.ts, l.event_id) < (a.ts, a.event_id) GROUP BY ALL),
held AS (SELECT c.event_id, any_value(c.org) AS org, any_value(c.customer) AS customer, arg_max(l.customer, (l.ts, l.event_id)) AS current
  FROM cand c JOIN links l ON l.org = c.org AND (l.ts, l.event_id) < (c.ts, c.event_id) GROUP BY c.event_id),
resolved AS (SELECT t.* EXCLUDE (org_id), coalesce(t.named, CASE WHEN h.current = h.customer THEN h.org END) AS org
  FROM told t LEFT JOIN held h USING (event_id)),
changes AS (SELECT org AS org_id, ts, event_id, type, plan_meta,
  CASE WHEN type = '{fixed.CHECKOUT_EVENT}' THEN coalesce(plan_meta, 'free')
       WHEN status IN {_in(fixed.ENTITLED_STATUSES)} THEN coalesce(plan_meta, {_case('unit_amount', {p[2]: p[0] for p in fixed.PLANS if p[2]})}, 'free')
       ELSE 'free' END AS plan,
  CASE WHEN type = '{fixed.CHECKOUT_EVENT}' THEN CASE WHEN trial = '1' THEN 'trialing' ELSE 'active' END ELSE status END AS status,
  customer, CASE WHEN type = '{fixed.CHECKOUT_EVENT}' THEN subscription ELSE object_id END AS subscription,
  CASE WHEN type <> '{fixed.CHECKOUT_EVENT}' THEN period_end END AS period_end,
  type <> '{fixed.CHECKOUT_EVENT}' AND cancel_at_period_end AS cancel_at_period_end
  FROM resolved WHERE writes AND org IS NOT NULL),
state AS (SELECT org_id, arg_max(plan, (ts, event_id)) AS plan, arg_max(status, (ts, event_id)) AS status,
  arg_max(customer, (ts, event_id)) FILTER (WHERE customer IS NOT NULL) AS customer,
  arg_max(subscription, (ts, event_id)) FILTER (WHERE subscription IS NOT NULL) AS subscription,
  arg_max(period_end, (ts, event_id)) FILTER (WHERE period_end IS NOT NULL) AS period_end,
  arg_max(cancel_at_period_end, (ts, event_id)) AS cancel_at_period_end, max(ts) AS updated_at FROM changes GROUP BY org_id)"""
_RUNS = f"runs AS ({_bind(derived.RUNS)})"
_ROWS = {p[0]: p[3] for p in fixed.PLANS}


def _plan(expr: str, at: int) -> str:
    return _case(expr, {p[0]: p[at] for p in fixed.PLANS},
                 _q(fixed.PLANS[0][at]) if isinstance(fixed.PLANS[0][at], str) else str(fixed.PLANS[0][at]))


_USAGE = """usage AS (SELECT org_id, CAST(date_trunc('month', created_at) AS DATE) AS period,
  CAST(sum(rows_in) AS BIGINT) AS rows_processed, count(*) AS jobs_run FROM runs GROUP BY ALL)"""

_LIMIT = _case("plan", fixed.REQUESTS_PER_MINUTE, "30")
_BUCKETS = f"""WITH RECURSIVE log AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) // 2160 AS us,
  CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'key_' || (user_id % 20) END AS key,
  CASE WHEN user_id % 3 = 0 THEN 'scale' WHEN user_id % 2 = 0 THEN 'signup' ELSE 'public' END AS plan FROM events),
numbered AS (SELECT event_id, key, us / 1000000.0::DOUBLE AS sec, CAST({_LIMIT} AS INT) AS lim,
  row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM log),
fold AS (SELECT event_id, key, sec, lim, n, lim - 1.0::DOUBLE AS tokens, true AS allowed FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.event_id, b.key, b.sec, b.lim, b.n, CASE WHEN b.full >= 1 THEN b.full - 1.0 ELSE b.full END, b.full >= 1
  FROM (SELECT s.event_id, s.key, s.sec, s.lim, s.n,
    least(s.lim::DOUBLE, fold.tokens + greatest(0.0, s.sec - fold.sec) * (s.lim / 60.0::DOUBLE)) AS full
    FROM fold JOIN numbered s ON s.key = fold.key AND s.n = fold.n + 1) b)
SELECT event_id, key, allowed, CASE WHEN allowed THEN CAST(floor(tokens) AS INT) ELSE 0 END AS remaining,
  CASE WHEN allowed THEN 0 ELSE greatest(1, CAST(floor((1.0 - tokens) / (lim / 60.0::DOUBLE)) AS INT) + 1) END AS retry_after,
  lim AS "limit" FROM fold"""


def _matches() -> str:
    rows = [
        ("Razón Social", "company", 0.95, "name"), ("Tlf", "phone", 0.95, "name"),
        ("Cuenta bancaria", "iban", 0.95, "name"), ("CP", "postal_code", 0.95, "name"),
        ("Edad", "age", 0.95, "name"), ("Persona de contacto", "name", 0.75, "name_contains"),
        ("Facturación anual", "income", 0.75, "name_contains"), ("Nº Cliente", "", 0.0, "unmapped"),
    ]
    values = ", ".join(f"('{s}', '{c}', {p}::DOUBLE, '{m}')" for s, c, p, m in rows)
    # Two columns have meaningless headers and are recognised by what they hold.
    email = (f"SELECT avg(CASE WHEN regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$') THEN 1.0 ELSE 0.0 END) AS r "
             f"FROM (SELECT email FROM crm) WHERE email <> ''")
    tax = (f"SELECT avg(CASE WHEN regexp_matches(tax_id, '^[0-9]{{7,8}}[A-Z]$') THEN 1.0 ELSE 0.0 END) AS r "
           f"FROM (SELECT tax_id FROM crm) WHERE tax_id <> ''")
    return f"""WITH {CRM} SELECT * FROM (VALUES {values}) AS v(source, canonical, confidence, method)
UNION ALL SELECT 'campo1', 'tax_id', round(0.6 + 0.3 * r, 4), 'content' FROM ({tax})
UNION ALL SELECT 'campo2', CASE WHEN r >= 0.8 THEN 'email' ELSE '' END, CASE WHEN r >= 0.8 THEN round(0.6 + 0.3 * r, 4) ELSE 0.0 END,
  CASE WHEN r >= 0.8 THEN 'content' ELSE 'unmapped' END FROM ({email})"""


_COUNTS = "SELECT rule, count(*) AS count FROM found GROUP BY rule"
_LABEL = _case("rule", fixed.RULE_LABELS, "rule")



def _sections() -> str:
    """The report as rows, written out section by section."""
    columns = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FIELDS.values()))

    def euros(e):
        return f"format('{{:,.2f}}', {e}) || ' EUR'"

    source = (f"El coste por incidencia lo ha aportado el cliente. Origen: {COST.source}. "
              "Esta cifra no se ha estimado ni validado.")
    return f"""{_RUN}, counts AS (SELECT rule, count(*) AS n, min((seq, row_id)) AS first FROM found GROUP BY rule),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) - 1 AS pos, count(*) OVER () AS kinds FROM counts),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE level < 2) AS good FROM levels),
e AS (SELECT count(*) FILTER (WHERE severity = 'error') AS errors FROM found)
SELECT 0 AS position, 'Resumen' AS section, line, label, value, alert, {_q(QUARANTINE_NOTE)} AS note FROM (
  SELECT 0 AS line, 'Filas analizadas' AS label, {_thousands('total')} AS value, false AS alert FROM t
  UNION ALL SELECT 1, 'Filas sin incidencias', {_thousands('good')}, false FROM t
  UNION ALL SELECT 2, 'Filas en cuarentena', {_thousands('total - good')}, total > good FROM t
  UNION ALL SELECT 3, 'Grupos de duplicados', '0', false)
UNION ALL SELECT 1, 'Incidencias por tipo', CAST(pos AS INT), {_LABEL}, {_thousands('n')}, false,
  CASE WHEN kinds > 12 THEN 'Se muestran los 12 tipos más frecuentes de ' || kinds || '.' ELSE '' END FROM ranked WHERE pos < 12
UNION ALL SELECT 2, 'Columnas reconocidas', i, f, f, false, '' FROM (VALUES {columns}) AS c(i, f)
UNION ALL SELECT 3, 'Impacto económico', 0, 'Incidencias demostrables', {_thousands('errors')}, false, {_q(source)} FROM e
UNION ALL SELECT 3, 'Impacto económico', 1, 'Coste por incidencia', {euros(f'{COST.euros_per_error}::DOUBLE')}, false, {_q(source)} FROM e
UNION ALL SELECT 3, 'Impacto económico', 2, 'Total', {euros(f'errors * {COST.euros_per_error}::DOUBLE')}, errors > 0, {_q(source)} FROM e
UNION ALL SELECT 4, 'Metodología', 0, NULL, NULL, NULL, {_q(METHOD_NOTE)}"""


ORACLES = {
    "tax_id_findings": _verdicts(_TAX, "tax_v"),
    "iban_findings": _verdicts(_IBAN, "iban_v"),
    "email_findings": _verdicts(_email("crm"), "email_v"),
    "phone_findings": _verdicts(_PHONE, "phone_v"),
    "postal_findings": _verdicts(_POSTAL, "postal_v"),
    "document_emails": (
        "WITH hits AS (SELECT doc_id, unnest(regexp_extract_all(text, "
        "'[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+')) AS email FROM documents), "
        f"{_email('hits', 'email', 'doc_id')} SELECT doc_id, raw AS email, rule, "
        f"{_mask_email('raw')} AS masked FROM email_v"),
    "text_keys": _text(key=_key("t"), plain=_plain("t"), spaced=_spaces("t")),
    "company_keys": (
        f"WITH {CRM}, {_NAMES}, k AS (SELECT src, id, {_key('t')} AS k FROM names) "
        f"SELECT src, id, {_company('k')} AS key FROM k"),
    "title_names": _text(title=_title("t")),
    "slugs": _text(slug=_slug("t")),
    "synthetic_names": _text(reason=_reason("t")),
    "text_values": (
        "SELECT o_orderkey, CAST(o_custkey * 1000 + 600000000 AS STRING) AS whole_text, "
        "CAST(o_custkey * 1000 + 600000000 AS STRING) AS suffix_text, "
        "regexp_replace(CAST(o_totalprice AS STRING), '[.]0$', '') AS price_text, "
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS token_text FROM orders"),
    "rule_texts": (
        f"{_RUN}, counts AS ({_COUNTS}) SELECT rule, "
        f"{_case("split_part(rule, '.', 1)", fixed.ACTION_TEXT)} AS action_text, {_LABEL} AS label, "
        f"{_thousands('count * 1000')} AS thousands FROM counts"),
    "formatted_ibans": (
        f"WITH {CRM} SELECT row_id, array_to_string(list_transform(range(0, CAST(ceil(length(iban) / 4) AS BIGINT)), "
        "lambda i: iban[i * 4 + 1:i * 4 + 4]), ' ') AS iban FROM crm"),
    "findings": (
        f"{_RUN} SELECT seq, row_id, \"column\", rule, severity, {_LEVEL} AS level, message, action, "
        "original, proposed, round(confidence, 6) AS confidence FROM found"),
    "quarantine_split": (
        f"{_RUN} SELECT bar AS quarantine_on, CASE WHEN level >= n THEN 'quarantine' ELSE 'valid' END AS side, row_id "
        "FROM levels, (VALUES ('info', 0), ('warning', 1), ('error', 2)) AS b(bar, n)"),
    "row_conservation": (
        f"{_RUN} SELECT count(*) AS rows_in, CAST(sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) AS BIGINT) AS rows_valid, "
        "CAST(sum(CASE WHEN level < 2 THEN 0 ELSE 1 END) AS BIGINT) AS rows_quarantined FROM levels"),
    "clean_values": _cleaned(True),
    "audit_only": _cleaned(False),
    "quality_gate": f"{_RUN} SELECT CAST(max(CASE WHEN level = 2 THEN 1 ELSE 0 END) AS INT) AS exit_code FROM levels",
    "outlier_model": _OUTLIER_MODEL,
    "outlier_flags": _flags("events", "event_id", "value"),
    "outlier_flags_grouped": _grouped_flags("events", "event_id", "value", "event_type"),
    "outlier_flags_by_user": _grouped_flags("events", "event_id", "value", "user_id"),
    "outlier_flags_by_digits": _grouped_flags(
        "lineitem", "l_orderkey, l_linenumber", "l_extendedprice", "l_returnflag, l_linestatus"),
    "outlier_flags_lineitem": _flags(
        "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", "l_extendedprice"),
    "domain_flags": (
        f"WITH {CRM} SELECT row_id, CASE WHEN age < 0 OR age > 120 THEN 'La edad debe estar entre 0 y 120 años.' END AS age_message, "
        "CASE WHEN income < 0 OR income > 10000000 THEN 'Ingresos anuales fuera de un rango plausible.' END AS income_message FROM crm"),
    "exact_key_links": (
        f"WITH {CRM}, {_EXACT_KEYS}, heads AS (SELECT *, min(row_id) OVER (PARTITION BY key_type, key) AS head FROM keyed) "
        "SELECT row_id, head, key_type, key FROM heads WHERE row_id <> head"),
    "name_keys": f"WITH {CRM}, {_NAME_KEY} SELECT * FROM name_keys",
    "block_sizes": (
        f"WITH {CRM}, {_NAME_KEY} SELECT block, count(*) AS entries, count(DISTINCT key) AS keys "
        "FROM name_keys WHERE key <> '' GROUP BY block"),
    "candidate_pairs": (
        f"WITH RECURSIVE {_similar()} "
        "SELECT block, key_a, key_b, round(score, 6) AS score FROM pairs"),
    "candidate_pairs_all_blocks": (
        f"WITH RECURSIVE {_similar()} SELECT block, key_a, key_b, round(score, 6) AS score FROM pairs"),
    "similar_name_groups": (
        f"WITH RECURSIVE {_similar()}, links AS (SELECT lo AS i, row_id AS j FROM name_keys JOIN distinct_keys USING (block, key) WHERE row_id <> lo "
        "UNION ALL SELECT lo_a, lo_b FROM pairs), "
        "both_ways AS (SELECT i AS a, j AS b FROM links UNION SELECT j, i FROM links), "
        "reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a), "
        "labels AS (SELECT a AS row_id, min(b) AS group_id FROM reach GROUP BY a) "
        "SELECT row_id, group_id, row_id = group_id AS is_survivor FROM labels"),
    "duplicate_groups_exact": f"{_EXACT_GROUPS} SELECT * EXCLUDE (group_id) FROM groups",
    "duplicate_members_exact": (
        f"{_EXACT_GROUPS} SELECT row_id, group_id, row_id = group_id AS is_survivor FROM labels"),
    "duplicate_groups_full": f"{_FULL_GROUPS} SELECT * EXCLUDE (group_id) FROM groups",
    "duplicate_rows_nested": (
        f"{_FULL_GROUPS} SELECT key_type, key_value, round(confidence, 4) AS confidence, survivor_row, size, 0::BIGINT AS part, "
        "(SELECT string_agg(CAST(row_id AS STRING), ',' ORDER BY row_id) FROM labels WHERE labels.group_id = groups.group_id AND row_id <> groups.group_id) AS duplicate_rows FROM groups"),
    "duplicate_findings": (
        f"{_FULL_GROUPS}, {_DUPLICATE_LINES} SELECT seq, row_id, \"column\", rule, severity, 1 AS level, message, action, original, proposed, confidence FROM repeats"),
    "pseudonymised": (
        f"WITH {CRM} SELECT row_id, "
        f"{', '.join(map(_token, ('name', 'company', 'email', 'phone', 'tax_id', 'iban')))} FROM crm"),
    "masked": (
        f"WITH {CRM} SELECT row_id, {_mask_email('email')} AS email, "
        f"{_stars("regexp_replace(phone, '[^0-9]', '', 'g')", 3)} AS phone, "
        f"{_stars('upper(trim(tax_id))', 4)} AS tax_id, {_stars('upper(trim(iban))', 4)} AS iban FROM crm"),
    "counts_by_rule": f"{_RUN} {_COUNTS}",
    "counts_by_severity": (
        f"{_RUN} SELECT " + ", ".join(
            f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in fixed.SEVERITIES) + " FROM found"),
    "top_rules": (
        f"{_RUN}, counts AS (SELECT rule, count(*) AS count, min((seq, row_id)) AS first FROM found GROUP BY rule) "
        f"SELECT rule, {_LABEL} AS label, count FROM counts ORDER BY count DESC, first LIMIT 12"),
    "cost_total": (
        f"{_RUN} SELECT count(*) FILTER (WHERE severity = 'error') AS errors, {COST.euros_per_error}::DOUBLE AS euros_per_error, "
        f"count(*) FILTER (WHERE severity = 'error') * {COST.euros_per_error}::DOUBLE AS total, '{COST.source}' AS cost_source FROM found"),
    "audit_report": (
        f"{_RUN}, {_FULL_PARTS}, {_DUPLICATE_LINES}, everything AS (SELECT rule, severity FROM found UNION ALL SELECT rule, severity FROM repeats) "
        f"SELECT '{fixed.ENGINE_VERSION}' AS engine_version, (SELECT count(*) FROM levels) AS rows_in, "
        "(SELECT count(*) FROM levels WHERE level < 2) AS rows_valid, (SELECT count(*) FROM levels WHERE level >= 2) AS rows_quarantined, "
        "(SELECT count(*) FROM groups) AS duplicate_groups, (SELECT CAST(sum(size - 1) AS BIGINT) FROM groups) AS duplicate_rows, "
        f"'{';'.join(sorted(f'{c}={f}' for f, c in FIELDS.items()))}' AS columns_detected, '' AS unmapped_columns, "
        "(SELECT string_agg(rule || '=' || n, ';' ORDER BY rule || '=' || n) FROM (SELECT rule, count(*) AS n FROM everything GROUP BY rule)) AS counts_by_rule, "
        "(SELECT 'error=' || count(*) FILTER (WHERE severity = 'error') || ';info=' || count(*) FILTER (WHERE severity = 'info') || ';warning=' || count(*) FILTER (WHERE severity = 'warning') FROM everything) AS counts_by_severity"),
    "report_sections": _sections(),
    "worklist": (
        f"{_RUN}, {_FULL_PARTS}, {_DUPLICATE_LINES} "
        + _lines("SELECT * FROM found UNION ALL SELECT * FROM repeats")),
    "worklist_summary": (
        f"{_RUN}, t AS (SELECT count(*) AS lines, count(*) FILTER (WHERE severity = 'error') AS errors, "
        "count(*) FILTER (WHERE severity = 'warning') AS to_review, count(DISTINCT row_id) AS rows FROM found WHERE severity <> 'info') "
        "SELECT *, errors || ' para corregir y ' || to_review || ' para revisar, repartidas en ' || rows || ' filas.' AS summary FROM t"),
    "monthly_usage": f"WITH {_RUNS}, {_USAGE} SELECT * FROM usage",
    "usage_remaining": (
        f"WITH {_RUNS}, {_USAGE}, orgs AS (SELECT org_id, max(plan) AS plan FROM runs GROUP BY org_id) "
        f"SELECT o.org_id, {_plan('o.plan', 0)} AS plan, coalesce(u.rows_processed, 0) AS rows_used, "
        f"CAST({_plan('o.plan', 3)} AS BIGINT) AS rows_included, greatest(0, {_plan('o.plan', 3)} - coalesce(u.rows_processed, 0)) AS rows_remaining "
        f"FROM orgs o LEFT JOIN usage u ON u.org_id = o.org_id AND u.period = DATE '{PERIOD}'"),
    "quota_decisions": (
        f"WITH {_RUNS}, {_USAGE}, asked AS (SELECT run_id, plan, coalesce(rows_processed, 0) AS rows_used, rows_in * 7 AS rows_requested, "
        f"{_plan('plan', 3)} AS lim, {_plan('plan', 1)} AS label FROM runs LEFT JOIN usage ON usage.org_id = runs.org_id AND period = DATE '{PERIOD}') "
        "SELECT run_id, plan, rows_used, rows_requested, rows_requested <= lim - rows_used AS allowed, "
        "CASE WHEN rows_requested <= lim - rows_used THEN '' "
        f"WHEN lim - rows_used <= 0 THEN 'Has consumido las ' || {_thousands('lim', ',')} || ' filas de tu plan ' || label || ' este mes. El contador se reinicia el día 1.' "
        f"ELSE 'Este fichero tiene ' || {_thousands('rows_requested', ',')} || ' filas y sólo te quedan ' || {_thousands('lim - rows_used', ',')} || ' en el plan ' || label || ' este mes.' END AS reason FROM asked"),
    "plan_from_amount": (
        f"WITH log AS ({_bind(derived.BILLING)}), twice AS (SELECT * FROM log UNION ALL SELECT * FROM log WHERE event_id % 50 = 0) "
        f"SELECT event_id, unit_amount, {_case('unit_amount', {p[2]: p[0] for p in fixed.PLANS if p[2]})} AS plan, {_plan('plan_meta', 3)} AS monthly_rows FROM twice"),
    "relevant_billing_events": f"WITH {_BILLING} SELECT event_id, type, status FROM billing",
    "billing_organisations": f"WITH {_BILLING} SELECT event_id, type, org FROM resolved",
    "subscription_state": f"WITH {_BILLING} SELECT * FROM state",
    "entitled_orgs": (
        f"WITH {_BILLING} SELECT org_id, plan, status FROM state WHERE plan <> 'free' AND status IN {_in(fixed.ENTITLED_STATUSES)}"),
    "billing_audit": (
        f"WITH {_BILLING} SELECT org_id, CASE WHEN type = '{fixed.CHECKOUT_EVENT}' THEN 'billing.checkout_completed' ELSE 'billing.subscription_updated' END AS action, "
        f"NULL AS target, CASE WHEN type = '{fixed.CHECKOUT_EVENT}' THEN 'plan=' || coalesce(plan_meta, 'free') ELSE 'plan=' || plan || ';status=' || status END AS metadata, ts AS created_at FROM changes "
        "UNION ALL SELECT org, 'billing.payment_failed', NULL, 'attempt=' || attempt_count || ';invoice=' || object_id, ts FROM resolved "
        f"WHERE type = '{fixed.PAYMENT_FAILED_EVENT}' AND org IS NOT NULL "
        "UNION ALL SELECT NULL, 'billing.event', CAST(event_id AS STRING), '', ts FROM billing"),
    "recent_runs": (
        f"WITH {_RUNS} SELECT *, CAST(row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, run_id DESC) AS INT) AS position "
        "FROM runs QUALIFY position <= 20"),
    "retained_runs": (
        f"WITH {_RUNS} SELECT * FROM runs WHERE created_at >= TIMESTAMP '{AS_OF}' - to_days(CAST({_plan('plan', 5)} AS INT))"),
    "tenant_runs": f"WITH {_RUNS} SELECT * FROM runs WHERE org_id = 'org_7'",
    "over_limit_events": _BUCKETS,
    "row_identity_filtered": (
        "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey FROM customer"),
    "row_identity": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_name FROM customer",
    "schema_matches": _matches(),
    "schema_matches_all_rows": _matches(),
    "stream_findings": f"{_RUN} SELECT row_id, \"column\", rule, severity, proposed FROM found",
}

_EDGES = f"crm AS ({_bind(derived.EDGES)})"
_TYPED = (f"typed AS ({_bind(derived.TYPED)}), crm AS (SELECT row_id, "
          "CAST(CAST(phone AS BIGINT) AS STRING) AS phone, CAST(postal_code AS STRING) AS postal_code "
          "FROM typed)")
ORACLES.update({
    **{f"{kind}_edge_findings": _verdicts(block, view).replace(CRM, _EDGES) for kind, block, view in (
        ("tax_id", _TAX, "tax_v"), ("iban", _IBAN, "iban_v"), ("email", _email("crm"), "email_v"),
        ("phone", _PHONE, "phone_v"), ("postal_code", _POSTAL, "postal_v"))},
    "edge_findings": ORACLES["findings"].replace(CRM, _EDGES),
    "typed_phone_findings": _verdicts(_PHONE, "phone_v").replace(CRM, _TYPED),
    "typed_postal_findings": _verdicts(_POSTAL, "postal_v").replace(CRM, _TYPED),
    "outlier_fallbacks": _OUTLIER_MODEL.replace(CRM, _TYPED).replace(_MODELS, " UNION ALL ".join([
        _model("fixed_value", "typed", "fixed_value"), _model("tied", "typed", "tied"),
        _model("worded", "(SELECT TRY_CAST(worded AS DOUBLE) AS worded FROM typed)", "worded")]))
    + " UNION ALL SELECT 'nothing', 0, 'empty', 0.0, 0.0, 0.0, 0.0, 0.0",
})

_NEAR_LINKS = """links AS (SELECT lo AS i, row_id AS j, 'name' AS key_type, key AS key_value, 0.9::DOUBLE AS confidence, 1 AS phase
  FROM name_keys JOIN distinct_keys USING (block, key) WHERE row_id <> lo
  UNION ALL SELECT least(lo_a, lo_b), greatest(lo_a, lo_b), 'name', CASE WHEN lo_a < lo_b THEN key_a ELSE key_b END, score * 0.9, 1 FROM pairs)"""
ORACLES.update({
    query: (f"WITH RECURSIVE {_similar(name)}, {_NEAR_LINKS}, {_COMPONENTS} SELECT key_type, key_value, "
            "round(confidence, 6) AS confidence, survivor_row, size FROM groups")
    for query, name in (("similar_company_evidence", ""), ("similar_person_evidence", "k"))})
ORACLES.update({
    "csv_round_trip": (
        "SELECT CAST(c_custkey AS STRING) AS id, lpad(CAST(c_custkey AS STRING), 8, '0') AS code, "
        "c_name || ', \"' || c_mktsegment || '\"' AS note, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS some FROM customer"),
    "records_round_trip": (
        "SELECT c_custkey AS id, c_name AS note, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::DOUBLE / 8 END AS share FROM customer"),
    "run_log_append": (
        f"WITH {_RUNS}, twice AS (SELECT * FROM runs UNION ALL SELECT * FROM runs WHERE run_id % 2 = 0) "
        "SELECT org_id, count(*) AS entries, CAST(sum(rows_in) AS BIGINT) AS rows_in FROM twice GROUP BY org_id"),
    "stream_events": ORACLES["relevant_billing_events"],
})


_CLEAN = _cleaned(True).replace(f"{_RUN} ", f"{_RUN}, clean AS (", 1) + ")"


def _masked_if_valid(column: str, masked: str) -> str:
    return f"CASE WHEN level < 2 THEN {masked} ELSE {column} END AS {column}"


_TYPED_FIX = ", ".join(
    f"coalesce(max(proposed) FILTER (WHERE \"column\" = '{c}' AND (severity = 'info' OR (severity = 'warning' "
    f"AND confidence >= 0.85 AND proposed IS NOT NULL))), any_value(crm.{c})) AS {c}"
    for c in ("phone", "postal_code"))
ORACLES.update({
    "typed_values": (
        f"WITH {_TYPED}, {_PHONE}, {_POSTAL}, found AS ({_identifier_findings(1, 'phone', 'phone_v')} "
        f"UNION ALL {_identifier_findings(4, 'postal_code', 'postal_v')}) "
        f"SELECT crm.row_id, {_TYPED_FIX} FROM crm LEFT JOIN found USING (row_id) GROUP BY crm.row_id"),
    "worklist_csv": (
        f"{_RUN}, lines AS (SELECT l.*, f.seq, CASE f.severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS prio "
        f"FROM ({_lines('SELECT * FROM found')}) l JOIN found f ON f.row_id + 2 = l.line AND f.\"column\" = l.field AND f.rule = l.rule) "
        "SELECT row_number() OVER (ORDER BY prio, line, field, seq) - 1 AS place, * EXCLUDE (prio, seq) FROM lines"),
    "report_json": (
        f"{_RUN} SELECT '{fixed.ENGINE_VERSION}' AS engine_version, (SELECT count(*) FROM levels) AS rows_in, "
        "(SELECT count(*) FROM levels WHERE level < 2) AS rows_valid, (SELECT count(*) FROM levels WHERE level >= 2) AS rows_quarantined, "
        "0 AS duplicate_groups, 0 AS duplicate_rows, "
        f"'{';'.join(sorted(f'{c}={f}' for f, c in FIELDS.items()))}' AS columns_detected, '' AS unmapped_columns, "
        "(SELECT string_agg(rule || '=' || n, ';' ORDER BY rule || '=' || n) FROM (SELECT rule, count(*) AS n FROM found GROUP BY rule)) AS counts_by_rule, "
        "(SELECT 'error=' || count(*) FILTER (WHERE severity = 'error') || ';info=' || count(*) FILTER (WHERE severity = 'info') || ';warning=' || count(*) FILTER (WHERE severity = 'warning') FROM found) AS counts_by_severity"),
    "run_log_retried": (
        f"WITH {_RUNS} SELECT org_id, 2 * count(*) AS entries, CAST(2 * sum(rows_in) AS BIGINT) AS rows_in FROM runs GROUP BY org_id"),
    "stream_split": (
        f"{_CLEAN} SELECT row_id, company, name, iban_out AS iban, * EXCLUDE (row_id, company, name, iban_out, level), "
        "CASE WHEN level < 2 THEN 'valid' ELSE 'quarantine' END AS side FROM ("
        f"SELECT row_id, company, name, postal_code, age, income, level, {_masked_if_valid('email', _mask_email('email'))}, "
        + _masked_if_valid("phone", _stars("regexp_replace(phone, '[^0-9]', '', 'g')", 3)) + ", "
        + _masked_if_valid("tax_id", _stars("upper(trim(tax_id))", 4)) + ", "
        + _masked_if_valid("iban", _stars("upper(trim(iban))", 4)).replace("AS iban", "AS iban_out")
        + " FROM clean JOIN levels USING (row_id))"),
    "stream_windows": (
        f"{_RUN} SELECT (1704067200 + row_id * 120) // 3600 * 3600 AS window_start, rule, count(*) AS count FROM found GROUP BY ALL"),
    "stream_usage": ORACLES["monthly_usage"],
    "stream_key_links": ORACLES["exact_key_links"],
    "stream_limits": ORACLES["over_limit_events"],
    "stream_subscription_state": ORACLES["subscription_state"],
})
