"""Joining rows to the groups they belong to when one group may be huge.

The usual shape here is: aggregate rows to one record per key (partial sums
collapse a hot key on the map side), then bring something of that record back
to every row. A plain shuffle join would send all rows of a hot key to one task.

``attach`` splits the groups by size. A group is *heavy* when it holds more than
``1 / MAX_HEAVY`` of all rows, so there can be at most ``MAX_HEAVY`` of them,
whatever the data: that short list is broadcast and its rows never move. The
rest joins by shuffle, where no key exceeds the heavy limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MAX_HEAVY = 1_000
MIN_HEAVY_ROWS = 1_000_000


def heavy_limit(total_rows: int, floor: int = MIN_HEAVY_ROWS) -> int:
    return max(floor, -(-total_rows // MAX_HEAVY))


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    floor: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one record per key, ``size`` rows each).

    ``groups`` should be materialised: it is read for its total and then once
    per branch. The sizes must count rows of ``rows`` and be present per key.
    """
    total = groups.agg(F.sum(size)).head()[0] or 0
    limit = heavy_limit(total, floor)
    if total <= limit:  # no group can be heavy
        return rows.join(groups, keys)
    is_heavy = F.col(size) > limit
    heavy, light = groups.where(is_heavy), groups.where(~is_heavy)
    hot = rows.join(F.broadcast(heavy), keys)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return hot.unionByName(cold)


def counted(
    rows: DataFrame, keys: list[str], size: str, floor: int = MIN_HEAVY_ROWS
) -> DataFrame:
    """Adds ``size``, how many of ``rows`` share the row's ``keys``; null keys leave.

    ``rows`` should be materialised. Where no group can be heavy one shuffle does it.
    """
    known = rows.dropna(subset=keys)
    if known.count() <= floor:
        return known.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    groups = materialize(known.groupBy(*keys).agg(F.count("*").alias(size)), "sizes")
    return attach(known, groups, keys, size, floor)
