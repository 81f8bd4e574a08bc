"""Entity resolution: exact keys, similar names inside a postal block, groups.

Rows never meet all rows of their group. A repeated key becomes one record
(size, first row) by partial aggregation and every other row links to that first
row, so a key shared by a third of the table yields a star, not a quadratic mess.
Names are compared once per distinct key of a block, and only when two keys share
two of their rarest letter pairs; the filter is lossless for the chosen threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import any_of, case, ident, literal, lookup, pinned, select, staged
from ..functions.text import cell_text, company_key, normalize_key, strip
from ..session import materialize
from .components import connected_components
from .skew import MIN_HEAVY_ROWS, attach, counted

KEY = ["key_type", "block", "key"]
_PHASE = {t: i for i, t in enumerate((*fixed.KEY_CONFIDENCE, "name"))}
_GRAM_CODES = 16_384
_CELL = 4_096
_FEW_KEYS = 2_000


@dataclass(frozen=True)
class Duplicates:
    members: DataFrame  # row_id, group_id, is_survivor
    groups: DataFrame  # group_id, key_type, key_value, confidence, survivor_row, size


def _usable(cell: str) -> str:
    """Text that can act as evidence: not null, blank or a null token."""
    return f"NOT {any_of(f"lower({strip(f"coalesce({cell}, '')")})", fixed.NULL_TOKENS)}"


def _cells(df: DataFrame, fields: dict[str, str], names) -> dict[str, str]:
    return {
        f: cell_text(ident(fields[f]), df.schema[fields[f]].dataType)
        for f in names if f in fields
    }


def with_name_key(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Adds ``__block`` (start of the raw postal code) and ``__key`` (comparison key).

    The company decides when there is one, the contact's name otherwise.
    """
    cells = _cells(df, fields, ("company", "name", "postal_code"))
    nothing = "CAST(NULL AS STRING)"
    company, name = cells.get("company", nothing), cells.get("name", nothing)
    block = f"substring(coalesce({cells.get('postal_code', nothing)}, ''), 1, 5)"
    stages = [
        {"__is_company": _usable(company),
         "__chosen": case((_usable(company), company), (_usable(name), name)),
         "__block": f"coalesce(nullif({block}, ''), '_')"},
        {"__plain": normalize_key("__chosen")},
    ]
    key = f"IF(__is_company, {company_key('__plain')}, __plain)"
    return staged(df, stages, [*map(ident, df.columns), "__block", pinned({"__key": key})])


def key_rows(df: DataFrame, fields: dict[str, str], row_id: str = "row_id") -> DataFrame:
    """One row per (row, usable key): ``row_id, key_type, block, key``."""
    slots = []
    for kind, cell in _cells(df, fields, fixed.KEY_CONFIDENCE).items():
        key = case((_usable(cell), f"lower({strip(cell)})"))
        slots.append(f"named_struct('key_type', '{kind}', 'block', '', 'key', {key})")
    if "company" in fields or "name" in fields:
        df = with_name_key(df, fields)
        slots.append(
            "named_struct('key_type', 'name', 'block', __block, 'key', nullif(__key, ''))")
    if not slots:
        slots = ["named_struct('key_type', '', 'block', '', 'key', CAST(NULL AS STRING))"]
    return df.selectExpr(
        f"{ident(row_id)} AS row_id", f"inline(array({', '.join(slots)}))"
    ).where("key IS NOT NULL")


def key_buckets(rows: DataFrame) -> DataFrame:
    """Key → number of rows, first and last row. A hot key collapses map-side."""
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))


def block_sizes(buckets: DataFrame) -> DataFrame:
    """Rows and distinct keys per postal block."""
    return buckets.where("key_type = 'name'").groupBy("block").agg(
        F.sum("n").alias("entries"), F.count("*").alias("keys"))


def _within_blocks(buckets: DataFrame, floor: int) -> DataFrame:
    """Name buckets with the number of different keys of their block, whatever its size."""
    return counted(buckets.where("key_type = 'name'"), ["block"], "keys", floor)


def star_links(rows: DataFrame, buckets: DataFrame, floor: int = MIN_HEAVY_ROWS) -> DataFrame:
    """Every later row of a repeated key linked to the first one."""
    repeated = buckets.where("n > 1").select(*KEY, "n", F.col("lo").alias("head"))
    linked = attach(rows, repeated, KEY, "n", floor).where("row_id <> head")
    return linked.select("row_id", "head", "key_type", "key")


# --- similar names ---------------------------------------------------------
#
# ratio = 2M / (la + lb) where M characters of both strings are matched in order.
# ratio >= t bounds what each side leaves unmatched, and with it how many of its
# letter q-grams the other side can lack: at most 2q(1-t)/(2-t) * length. If both
# sides list their distinct grams in one global order, the first two common grams
# lie within that many + 2 of the start on both sides. Sorting by rarity keeps the
# join groups small. Pairs sharing such a gram are then cut by lengths and by an
# edit distance that never exceeds la + lb - 2M, all inside the join.

def _gram_size(threshold: float) -> int:
    return 2 if threshold > 0.86 else 1  # pairs survive for certain above 6/7


def _gram_codes(key: str, q: int) -> str:
    """Distinct q-grams (q ≤ 2) of a string as small integers."""
    second = f" + ascii(substring({key}, i + 1, 1))" if q == 2 else ""
    code = f"pmod(ascii(substring({key}, i, 1)) * 128{second}, {_GRAM_CODES})"
    last = f"length({key}) - {q - 1}"
    return case((f"{last} >= 1", (
        f"array_distinct(transform(sequence(1, greatest({last}, 1)), i -> {code}))")))


def _gram_prefixes(keys: DataFrame, threshold: float) -> DataFrame:
    """Adds ``gram``: one row per signature that a similar key must share.

    A signature is a pair of rare grams: two lists with at least two grams in
    common share both of their first two common ones within one gram more than
    the prefix for one. Keys too short to be sure of two common grams also give
    the single grams of their prefix, for each other.
    """
    q = _gram_size(threshold)
    coded = select(keys, {"codes": _gram_codes("key", q)})
    # At most _GRAM_CODES counters reach the driver, whatever the data.
    counts = dict(coded.selectExpr("explode(codes) AS c").groupBy("c").count().collect())
    table = ",".join(str(counts.get(c, 0)) for c in range(_GRAM_CODES))
    share = literal(2.0 * q * (1 - threshold) / (2 - threshold))
    ordered = (
        f"array_sort(transform(codes, c -> struct(element_at("
        f"CAST(split('{table}', ',') AS ARRAY<BIGINT>), c + 1) AS f, c AS c))).c")
    listed = select(coded, {
        "listed": ordered, "miss": f"CAST(floor(length(key) * {share} + 1e-9D) AS INT)"})
    first = select(listed, {"first": "slice(listed, 1, miss + 2)"})
    pairs = (
        "flatten(transform(sequence(1, greatest(size(first) - 1, 1)), i -> transform("
        "slice(first, i + 1, size(first)), y -> "
        f"(element_at(first, i) + 1L) * {_GRAM_CODES} + y)))")
    alone = "IF(size(listed) < miss + 2, slice(listed, 1, miss + 1), array())"
    many = f"concat(transform({alone}, x -> CAST(x AS BIGINT)), {pairs})"
    if "keys" in keys.columns:
        few = "transform(slice(listed, 1, miss + 1), x -> CAST(x AS BIGINT))"
        many = f"IF(keys <= {_FEW_KEYS}, {few}, {many})"
    return select(first.where("size(first) > 0"), {"gram": f"explode({many})"},
                  keep=[c for c in keys.columns if c != "keys"])


def name_candidates(
    keys: DataFrame, threshold: float, floor: int = MIN_HEAVY_ROWS
) -> DataFrame:
    """Pairs of distinct keys of one block that may reach the threshold.

    ``keys``: block, key, lo, hi (one record per distinct key of a block) and, if
    known, keys (how many there are in the block, the same for all of a block). A
    signature that many keys of a block share becomes a grid of cells, one task
    each.
    """
    tokens = materialize(
        _gram_prefixes(keys.select("block", "key", "lo", "hi", *(
            c for c in keys.columns if c == "keys")), threshold), "tokens")
    on = ["block", "gram"]
    sized = select(counted(tokens, on, "n", floor).where("n > 1"), {
        "cells": f"CAST(ceil(n / {_CELL}) AS INT)"})
    left = select(sized, {"cell": "CAST(pmod(xxhash64(key), cells) AS INT)"})
    right = select(sized, {"cell": "explode(sequence(0, cells - 1))"})
    la, lb = "length(a.key)", "length(b.key)"
    condition = " AND ".join([
        *[f"a.{c} = b.{c}" for c in (*on, "cell")],
        "a.key < b.key",
        f"abs({la} - {lb}) / greatest({la}, {lb}) <= 0.2D",
        f"2 * least({la}, {lb}) >= {literal(float(threshold))} * ({la} + {lb}) - 1e-9D",
        f"levenshtein(a.key, b.key, CAST(floor(({la} + {lb}) * {literal(1.0 - threshold)} "
        "+ 1e-9D) AS INT)) >= 0",
    ])
    return left.alias("a").join(right.alias("b"), F.expr(condition)).selectExpr(
        "a.block AS block", "a.key AS key_a", "b.key AS key_b", "a.lo AS lo_a", "a.hi AS hi_a",
        "b.lo AS lo_b", "b.hi AS hi_b").dropDuplicates(["block", "key_a", "key_b"])


def _ratio_udf():
    """Similarity of candidate pairs; the earlier row's text always goes first.

    The measure is not symmetric, so both orders count when rows interleave.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series, a_first: pd.Series, b_first: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for x, y, xy, yx in zip(a, b, a_first, b_first):
            best = SequenceMatcher(None, x, y).ratio() if xy else 0.0
            if yx:
                best = max(best, SequenceMatcher(None, y, x).ratio())
            out.append(best)
        return pd.Series(out, dtype="float64")

    return ratio.asNondeterministic()


def score_names(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs that reach the threshold, with their ``score``."""
    score = _ratio_udf()("key_a", "key_b", F.expr("lo_a < hi_b"), F.expr("lo_b < hi_a"))
    return candidates.withColumn("score", score).where(f"score >= {literal(float(threshold))}")


# --- groups ----------------------------------------------------------------

def _evidence(links: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """The strongest link a repeated key or a similar pair can contribute.

    Within a repeated key all links weigh the same, so its first two rows speak
    for it. A pair of keys that themselves repeat is weaker than the repetition.
    """
    weight = lookup("key_type", fixed.KEY_CONFIDENCE, literal(fixed.NAME_WEIGHT))
    found = links.groupBy("key_type", "head").agg(
        F.min("row_id").alias("j"), F.max("key").alias("key_value")
    ).selectExpr("head AS i", "j", "key_type", "key_value", f"{weight} AS confidence")
    if pairs is None:
        return found
    return found.unionByName(pairs.selectExpr(
        "least(lo_a, lo_b) AS i", "greatest(lo_a, lo_b) AS j", "'name' AS key_type",
        "IF(lo_a < lo_b, key_a, key_b) AS key_value",
        f"score * {literal(fixed.NAME_WEIGHT)} AS confidence"))


def build_groups(
    links: DataFrame, pairs: DataFrame | None = None, floor: int = MIN_HEAVY_ROWS
) -> Duplicates:
    """Transitive groups of linked rows with their best evidence."""
    edges = links.select(F.col("row_id").alias("a"), F.col("head").alias("b"))
    if pairs is not None:
        edges = edges.unionByName(pairs.select(F.col("lo_a").alias("a"), F.col("lo_b").alias("b")))
    labels = connected_components(edges, floor)
    members = labels.select(
        "row_id", "group_id", (F.col("row_id") == F.col("group_id")).alias("is_survivor"))

    strength = f"struct(confidence, -i, -j, -{lookup('key_type', _PHASE, '9')})"
    best = _evidence(links, pairs).join(labels.withColumnRenamed("row_id", "i"), "i").groupBy(
        "group_id").agg(F.expr(
            f"max_by(struct(key_type, key_value, confidence), {strength}) AS e"))
    sizes = labels.groupBy("group_id").agg(F.count("*").cast("int").alias("size"))
    groups = best.join(sizes, "group_id").select(
        "group_id", "e.key_type", "e.key_value", "e.confidence",
        F.col("group_id").alias("survivor_row"), "size")
    return Duplicates(members, materialize(groups, "groups"))


def exact_duplicates(
    df: DataFrame, fields: dict[str, str], row_id: str = "row_id", floor: int = MIN_HEAVY_ROWS
) -> Duplicates:
    """Groups by shared tax id, IBAN, e-mail or phone only."""
    keys = {f: c for f, c in fields.items() if f in fixed.KEY_CONFIDENCE}
    rows = key_rows(df, keys, row_id)
    buckets = materialize(key_buckets(rows).where("n > 1"), "buckets")
    return build_groups(materialize(star_links(rows, buckets, floor), "links"), None, floor)


def name_pairs(
    df: DataFrame, fields: dict[str, str], row_id: str = "row_id",
    threshold: float = fixed.NAME_MATCH_THRESHOLD,
    floor: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """Scored pairs of different names inside a block, without building groups."""
    names = {f: c for f, c in fields.items() if f in ("company", "name", "postal_code")}
    buckets = materialize(key_buckets(key_rows(df, names, row_id)), "buckets")
    inside = _within_blocks(buckets, floor).where("keys > 1")
    return score_names(name_candidates(inside, threshold, floor), threshold)


def find_duplicates(
    df: DataFrame,
    fields: dict[str, str],
    row_id: str = "row_id",
    threshold: float = fixed.NAME_MATCH_THRESHOLD,
    floor: int = MIN_HEAVY_ROWS,
) -> Duplicates:
    """Groups by exact keys and by similar names within a postal block."""
    if not 0 < threshold <= 1:
        raise ValueError("The name threshold must lie in (0, 1].")
    if "company" not in fields and "name" not in fields:
        return exact_duplicates(df, fields, row_id, floor)
    rows = materialize(key_rows(df, fields, row_id), "rows")  # four consumers
    buckets = materialize(key_buckets(rows).where("n > 1 or key_type = 'name'"), "buckets")
    inside = materialize(_within_blocks(buckets, floor), "names")
    repeated = buckets.where("key_type <> 'name'").unionByName(
        inside.select(*buckets.columns)).where("n > 1")
    links = materialize(star_links(rows, repeated, floor), "links")
    candidates = name_candidates(inside.where("keys > 1"), threshold, floor)
    pairs = materialize(score_names(candidates, threshold), "pairs")
    return build_groups(links, pairs, floor)


# --- shapes for consumers --------------------------------------------------

def duplicate_findings(found: Duplicates, floor: int = MIN_HEAVY_ROWS) -> DataFrame:
    """One warning per row that repeats a surviving one."""
    evidence = found.groups.select("group_id", "key_type", "confidence", "size")
    known = attach(found.members, evidence, ["group_id"], "size", floor).where("not is_survivor")
    return known.selectExpr(
        f"{fixed.DUPLICATE_SEQ} AS seq", "row_id", f"'{fixed.ROW_COLUMN}' AS column",
        "'duplicate.group' AS rule", "'warning' AS severity", "1 AS level",
        "concat('Duplicado de la fila ', group_id, ' por coincidencia de ', key_type, '.') "
        "AS message",
        "'kept' AS action", "CAST(NULL AS STRING) AS original",
        "CAST(NULL AS STRING) AS proposed", "confidence")


def nested_groups(
    found: Duplicates, part_rows: int = 100_000, floor: int = MIN_HEAVY_ROWS
) -> DataFrame:
    """Groups with their duplicate rows as an array, strongest evidence first.

    A record holds the rows of one stretch of ``part_rows`` row numbers (``part``),
    for every group alike, so no array outgrows a task.
    """
    sized = attach(found.members, found.groups, ["group_id"], "size", floor)
    part = F.floor(F.col("row_id") / part_rows)
    others = F.collect_list(F.when(~F.col("is_survivor"), F.col("row_id")))
    return (
        sized.groupBy(
            "key_type", "key_value", F.round("confidence", 4).alias("confidence"),
            "survivor_row", "size", part.cast("bigint").alias("part"))
        .agg(F.array_sort(others).alias("duplicate_rows"))
        .orderBy(F.desc("confidence"), "survivor_row", "part")
    )
