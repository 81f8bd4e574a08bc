"""Column recognition: which column of a file is which customer field.

The content evidence comes from one aggregate over every row; the decision over a few hundred headers then runs on the driver.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import any_of, ident, quote
from ..functions.text import SPACE, cell_text, strip


@dataclass(frozen=True)
class Match:
    source: str
    canonical: str
    confidence: float
    method: str


@dataclass(frozen=True)
class Profile:
    """Content evidence of one column."""

    present: int  # values that hold text
    numeric: float  # share of those that look like a number
    hits: dict[str, float]  # field → share of non-empty values matching its pattern

    def contradicts(self, field: str) -> bool:
        """A text field cannot live in a column that is nothing but numbers."""
        return field in fixed.TEXT_FIELDS and self.present >= 3 and self.numeric >= 0.9


_NO_PROFILE = Profile(0, 0.0, {})
_SPACED_PATTERNS = {
    field: pattern.replace(r"[^@\s]", "[^@" + SPACE[1:])
    for field, pattern, _ in fixed.CONTENT_PATTERNS
}


def header_key(header: str) -> str:
    """``normalize_key`` for a header, on the driver."""
    text = "".join(" " if c in "º°ª" else c for c in str(header))
    plain = "".join(
        c if c in "ñÑ" else "".join(
            d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        for c in text
    ).lower()
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in plain).split())


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> dict[str, Profile]:
    """Evidence from every row, in one aggregate with partial sums."""
    columns = columns or list(df.columns)
    aggs = []
    for i, name in enumerate(columns):
        aggs += _measures(cell_text(ident(name), df.schema[name].dataType), f"c{i}_")
    row = df.selectExpr(*aggs).head().asDict()
    return {name: _as_profile(row, f"c{i}_") for i, name in enumerate(columns)}


def _measures(cell: str, prefix: str) -> list[str]:
    trimmed = strip(cell)
    filled = f"{cell} IS NOT NULL AND NOT {any_of(trimmed, ('', 'nan', 'None'))}"
    counted = {
        "present": filled,
        "numeric": f"{filled} AND {trimmed} RLIKE {quote(fixed.NUMERIC_TEXT)}",
        "filled": f"{cell} <> ''",
    }
    for field, pattern in _SPACED_PATTERNS.items():
        counted[field] = f"{cell} <> '' AND {trimmed} RLIKE {quote(pattern)}"
    return [f"count_if({test}) AS {prefix}{name}" for name, test in counted.items()]


def _as_profile(row: dict, prefix: str) -> Profile:
    present, filled = row[prefix + "present"], row[prefix + "filled"]
    return Profile(
        present,
        row[prefix + "numeric"] / present if present else 0.0,
        {f: row[prefix + f] / filled for f in _SPACED_PATTERNS} if filled else {},
    )


def _synonyms() -> dict[str, str]:
    return {header_key(s): field for field, words in fixed.SYNONYMS.items() for s in words}


def assign(
    columns: list[str],
    profiles: dict[str, Profile] | None = None,
    overrides: dict[str, str] | None = None,
) -> tuple[list[Match], list[str]]:
    """Give each field to the first column that claims it, strongest claim first."""
    profiles = profiles or {}
    index = _synonyms()
    longest_first = sorted((s for s in index if len(s) >= 4), key=len, reverse=True)
    free = set(columns)
    taken: dict[str, Match] = {}

    def contradicted(source, field):
        return profiles.get(source, _NO_PROFILE).contradicts(field)

    def by_override(source):
        field = (overrides or {}).get(source)
        return field and (field, 1.0, "override")

    def by_name(source):
        field = index.get(header_key(source))
        if field and field not in taken and not contradicted(source, field):
            return field, 0.95, "name"

    def by_part_of_name(source):
        key = header_key(source)
        for word in longest_first:
            field = index[word]
            if field in taken or not re.search(rf"\b{re.escape(word)}\b", key):
                continue
            if not contradicted(source, field):
                return field, 0.75, "name_contains"

    def by_content(source):
        hits = profiles.get(source, _NO_PROFILE).hits
        for field, _, base in fixed.CONTENT_PATTERNS:
            if field not in taken and hits.get(field, 0.0) >= 0.8:
                return field, base + 0.3 * hits[field], "content"

    for claim, order in (
        (by_override, list(overrides or {})), (by_name, columns),
        (by_part_of_name, columns), (by_content, columns),
    ):
        for source in order:
            found = claim(source) if source in free else None
            if found and found[0] not in taken:
                taken[found[0]] = Match(source, *found)
                free.discard(source)
    return list(taken.values()), [c for c in columns if c in free]


def detect_schema(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    row_id: str | None = None,
) -> tuple[list[Match], list[str]]:
    """Recognise the columns of ``df``; returns the matches and what stays unmapped."""
    columns = [c for c in df.columns if c != row_id]
    evidence = profile_columns(df, columns) if columns else {}
    return assign(columns, evidence, overrides)


def matches_table(spark: SparkSession, matches: list[Match]) -> DataFrame:
    return spark.createDataFrame(
        [(m.source, m.canonical, m.confidence, m.method) for m in matches],
        "source string, canonical string, confidence double, method string")
