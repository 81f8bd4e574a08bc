"""Text expressions: each function maps a SQL expression to a SQL expression.

Only codegen-friendly built-ins (no Python, no lambdas), so a projection that
uses them stays inside one whole-stage pipeline. Use them with ``selectExpr`` or
``F.expr``; ``normalize_columns`` applies them to a table by name.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .sql import any_of, case, ident, lookup, quote, replace

# Unicode white space, written out because the regex shorthand is ASCII-only.
_SPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACES = "".join(map(chr, _SPACE_CODES))
SPACE = "[" + "".join(f"\\u{c:04x}" for c in _SPACE_CODES) + "]"


def strip(e: str) -> str:
    """Trim Unicode white space at both ends."""
    return f"trim(BOTH {quote(SPACES)} FROM {e})"


def _accent_table() -> tuple[str, str]:
    """Single characters that decompose to one base letter, and that letter.

    Combining marks have no counterpart and are therefore deleted by
    ``translate``. ñ and Ñ are letters of their own and stay.
    """
    src, dst, marks = [], [], []
    for code in [*range(0xA0, 0x2000), *range(0xFF01, 0xFF5F)]:
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != ch and ch not in "ñÑ":
            src.append(ch)
            dst.append(base)
    return "".join(src) + "".join(marks), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(e: str) -> str:
    """Drop accents but keep ñ/Ñ, which are not accented letters in Spanish."""
    return f"translate({e}, {quote(_ACCENTED)}, {quote(_PLAIN)})"


def strip_accents_unicode(col: Column) -> Column:
    """Same over all of Unicode (ligatures and the like), through an Arrow UDF.

    ``strip_accents`` covers every one-to-one letter natively; this variant is
    for data with compatibility characters that expand to several letters.
    """
    @F.pandas_udf("string")
    def full(values: pd.Series) -> pd.Series:
        import unicodedata as u

        def one(v):
            if v is None:
                return None
            parts = (
                c if c in "ñÑ" else "".join(
                    d for d in u.normalize("NFKD", c) if not u.combining(d))
                for c in v
            )
            return "".join(parts)

        return values.map(one)

    return full(col)


_OTHER_SPACES = SPACES.replace(" ", "")


def collapse_spaces(e: str) -> str:
    """Runs of white space become one space, none at the ends."""
    even = f"translate({e}, {quote(_OTHER_SPACES)}, {quote(' ' * len(_OTHER_SPACES))})"
    return f"trim(IF(contains({even}, '  '), regexp_replace({even}, ' +', ' '), {even}))"


def normalize_key(e: str) -> str:
    """Comparison key: lower case, no accents, no punctuation, single spaces."""
    plain = strip_accents(f"translate(coalesce({e}, ''), 'º°ª', '   ')")
    return f"trim(regexp_replace(lower({plain}), {quote('[^\\p{L}\\p{N}_]+')}, ' '))"


_FORMS = sorted(
    (form for forms in fixed.LEGAL_FORMS.values() for form in forms),
    key=lambda f: (-len(f.split()), f),
)
_FORM = "(?<![^ ])(" + "|".join(_FORMS) + ")(?![^ ])"


def company_key(key: str) -> str:
    """Legal forms removed from a normalised key; the last one found goes last."""
    last = f"regexp_extract({key}, {quote('^.*' + _FORM)}, 1)"
    short = lookup(last, {f: code for code, fs in fixed.LEGAL_FORMS.items() for f in fs}, "''")
    kept = f"trim(regexp_replace({key}, {quote(_FORM + ' ?')}, ''))"
    return f"IF({last} = '', {key}, ltrim(concat({kept}, ' ', {short})))"


def normalize_company(e: str) -> str:
    return company_key(normalize_key(e))


_MARK = "\x01"  # keeps the word after it from being capitalised
_PARTICLE = "(?<= )(" + "|".join(fixed.NAME_PARTICLES) + ")(?= |$)"


def title_of_tidy(tidy: str) -> str:
    """``title_case_name`` of a text whose spaces are already collapsed."""
    lowered = f"lower({tidy})"
    marked = f"regexp_replace({lowered}, {quote(_PARTICLE)}, {quote(_MARK + '$1')})"
    return case(
        (f"{lowered} RLIKE {quote(_PARTICLE)}",
         f"translate(initcap({marked}), {quote(_MARK)}, '')"),
        default=f"initcap({lowered})")


def title_case_name(e: str) -> str:
    """Capitalise each word; Spanish particles stay lower except in first place."""
    return title_of_tidy(collapse_spaces(f"coalesce({e}, '')"))


def reason_of_tidy(tidy: str) -> str:
    """``synthetic_reason`` of a text whose spaces are already collapsed."""
    return case(
        (f"{tidy} = ''", "'Nombre vacío.'"),
        (f"length({tidy}) < 2", "'Nombre de un solo carácter.'"),
        (f"{tidy} RLIKE {quote('\\p{Nd}')}", "'El nombre contiene dígitos.'"),
        (f"{tidy} RLIKE {quote('(?iu)(.)\\1{3,}|^[^a-záéíóúüñ]+$')}",
         "'Patrón de tecleo aleatorio o sin letras.'"),
        (any_of(normalize_key(tidy), fixed.NAME_FILLERS), "'Valor de relleno de formulario.'"),
    )


def synthetic_reason(e: str) -> str:
    """Why a name looks invented, or null when it does not."""
    return reason_of_tidy(collapse_spaces(f"coalesce({e}, '')"))


def slugify(e: str, fallback: str = "organizacion") -> str:
    plain = strip_accents(f"translate(coalesce({e}, 'None'), 'ñÑ', 'nN')")
    ascii_only = f"lower(regexp_replace({plain}, {quote('[^\\x00-\\x7f]')}, ''))"
    dashed = f"trim(BOTH '-' FROM regexp_replace({ascii_only}, '[^a-z0-9]+', '-'))"
    slug = f"trim(BOTH '-' FROM substring({dashed}, 1, 63))"
    return case((f"length({slug}) < 2", quote(fallback)), default=slug)


# --- typed cells to text ---------------------------------------------------

def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _float_digits(value: str) -> str:
    """Digits of a non-integral double, without exponent form when |x| ≥ 1e-4."""
    java = f"CAST({value} AS STRING)"
    plain = f"trim(TRAILING '0' FROM CAST(try_cast({java} AS DECIMAL(38,18)) AS STRING))"
    return case(
        (f"contains({java}, 'E') AND abs({value}) >= 1e-4D", f"coalesce({plain}, {java})"),
        default=java)


def float_repr(value: str) -> str:
    """A double the way it is shown to people: ``150.0``, ``25000000.0``, ``0.5``."""
    return case(
        (f"floor({value}) = {value} AND abs({value}) < 1e16D",
         f"concat(CAST(try_cast({value} AS DECIMAL(38,0)) AS STRING), '.0')"),
        default=_float_digits(value))


def cell_text(e: str, dtype: T.DataType) -> str:
    """Plain text of a raw cell; null and NaN stay null."""
    if isinstance(dtype, T.StringType):
        return e
    if is_float(dtype):
        value = f"CAST({e} AS DOUBLE)"
        return case((f"NOT isnan({e})", float_repr(value)))
    if isinstance(dtype, T.BooleanType):
        return f"initcap(CAST({e} AS STRING))"
    return f"CAST({e} AS STRING)"


def text_of_stripped(text: str) -> str:
    """``text_value`` of a text that is already trimmed."""
    return case(
        (any_of(f"lower({text})", fixed.NULL_TOKENS), "''"),
        (f"{text} RLIKE '^-?[0-9]+[.]0+$'", f"substring_index({text}, '.', 1)"),
        default=text)


def text_value(e: str, dtype: T.DataType | None = None) -> str:
    """Cell as clean text: null tokens become '', whole doubles lose their '.0'."""
    if dtype is not None and is_float(dtype):
        v = f"CAST({e} AS DOUBLE)"
        whole = f"coalesce(CAST(try_cast({v} AS DECIMAL(38,0)) AS STRING), CAST({v} AS STRING))"
        return case(
            (f"{e} IS NULL OR isnan({e})", "''"), (f"floor({v}) = {v}", whole),
            default=_float_digits(v))
    if isinstance(dtype, T.IntegralType):
        return f"coalesce(CAST({e} AS STRING), '')"
    return text_of_stripped(strip(f"coalesce({cell_text(e, dtype or T.StringType())}, '')"))


def column_as_text(e: str, dtype: T.DataType) -> str:
    """``text_value`` that keeps nulls null, for columns widened to text."""
    present = f"{e} IS NOT NULL" + (f" AND NOT isnan({e})" if is_float(dtype) else "")
    return case((present, text_value(e, dtype)))


def thousands(e: str, separator: str = ".") -> str:
    text = f"format_number({e}, 0)"
    return text if separator == "," else f"translate({text}, ',', {quote(separator)})"


def action_for(rule: str) -> str:
    """Instruction for a rule, by its family."""
    return lookup(
        f"substring_index({rule}, '.', 1)", fixed.ACTION_TEXT, quote(fixed.DEFAULT_ACTION_TEXT))


def rule_label(rule: str) -> str:
    return lookup(rule, fixed.RULE_LABELS, rule)


def format_iban(e: str) -> str:
    return f"trim(regexp_replace({e}, '(.{{4}})', '$1 '))"


FUNCTIONS = {
    "text_value": text_value,
    "strip_accents": strip_accents,
    "collapse_spaces": collapse_spaces,
    "normalize_key": normalize_key,
    "normalize_company": normalize_company,
    "title_case_name": title_case_name,
    "synthetic_reason": synthetic_reason,
    "slugify": slugify,
    "format_iban": format_iban,
    "action_for": action_for,
    "rule_label": rule_label,
}


def normalize_columns(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Apply named text functions to columns of a table in one projection."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return replace(df, {
        name: text_value(ident(name), types[name]) if fn == "text_value"
        else FUNCTIONS[fn](cell_text(ident(name), types[name]))
        for name, fn in plan.items()
    })
