"""Bounded samples to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that the first look lets through for each row that is wanted of a group.
SPREAD = 8


def bounded(df: DataFrame, keys: list[str], rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows with the smallest hashes of ``keys``, out of ``total``.

    A share of the hashes is let through first, so that the tasks together send
    about four times the sample however many they are. The same rows give the
    same sample; rows alike in ``keys`` count each.
    """
    share = max(1, total // max(1, 4 * rows))
    own = F.xxhash64(*keys)
    return df.where(F.pmod(own, F.lit(share)) == 0).orderBy(own, *keys).limit(rows)


def smallest(df: DataFrame, group, sizes: dict, rows: int,
             spread: int = SPREAD) -> DataFrame | None:
    """``side, h, text``: of each group the ``rows`` different texts with the smallest hashes.

    ``group`` is the column that tells a text's group (null: none), ``sizes`` an
    estimate of the rows of each group that is wanted. Hashes come first: only texts whose
    hash lies below a limit have their group computed, so that the first look handles
    about ``spread`` texts for each wanted one. A group that shows fewer than ``rows`` (it is rarer
    than estimated, or holds many copies) is looked at again under a higher limit, in
    the end under none. The result does not depend on the limits. Copies count once.
    None if no group is asked for.
    """
    spark, out = df.sparkSession, None
    left = {side: min(1.0, spread * rows / max(1, size)) for side, size in sizes.items()}
    keyed = df.where("text is not null").select(F.xxhash64("text").alias("h"), "*")
    order = Window.partitionBy("side").orderBy("h", "text")
    while left:
        limits = {s: min(2**63 - 1, int(share * 2**64) - 2**63) for s, share in left.items()}
        one = spark.createDataFrame(list(limits.items()),
                                    f"side {_type_of(limits)}, most long")  # a row for each group
        found = keyed.where(F.col("h") <= max(limits.values())).select(
            group.alias("side"), "h", "text").join(F.broadcast(one), "side").where(
            "h <= most").select("side", "h", "text").distinct().withColumn(
            "n", F.row_number().over(order)).where(F.col("n") <= rows).drop("n")
        found = materialize(found, "sample")
        seen = {r.side: r["count"] for r in found.groupBy("side").count().collect()}
        done = [s for s, share in left.items() if seen.get(s, 0) >= rows or share >= 1]
        if done:
            part = found.where(F.col("side").isin(done))
            out = part if out is None else out.unionByName(part)
        left = {s: min(1.0, share * max(8.0, 2 * rows / seen[s])) if seen.get(s) else 1.0
                for s, share in left.items() if s not in done}
    return out


def _type_of(sides) -> str:
    return "boolean" if isinstance(next(iter(sides)), bool) else "string"
