"""Token counts (operator 2).

Documents are aggregated to the exact histogram of their encoded lengths; suffix
sums of documents and tokens then answer totals, quantiles and truncated totals
for every context limit. The sums are taken within blocks of lengths and over
blocks, so no task sees the whole histogram.

A null text counts as empty: length 0. Repeated rows count each. An empty table
gives an empty histogram. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding
from .common import materialize, per_text

BLOCK = 1024


def token_lengths(df: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text, without special tokens."""
    path = path or encoding.default_path("byte_bpe_50k.tiktoken")

    def step(batch, texts):
        at, _ = encoding.encode(texts, path)
        return [batch.column("doc_id"), pa.array(at[1:] - at[:-1], pa.int64())]

    return per_text(df.select("doc_id", "text"), step, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, docs`` by partial aggregation."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """What every context limit gives, one row per length that occurs.

    ``docs_from`` and ``tokens_from`` sum over documents of at least that length;
    ``truncated_tokens`` is the total if every document is cut at that length,
    ``share_upto`` the share of documents that are not longer. Totals between two
    lengths follow: ``docs_from`` of the next longer length times the difference.
    """
    rows = counts.withColumn("block", F.expr(f"n_tokens div {block}")).withColumn(
        "tokens", F.col("n_tokens") * F.col("docs"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(
        Window.unboundedPreceding, 0)
    out = rows.withColumn("docs_from", F.sum("docs").over(here)).withColumn(
        "tokens_from", F.sum("tokens").over(here)).join(blocks, "block")
    docs_from, tokens_from = F.expr("docs_from + d_later"), F.expr("tokens_from + t_later")
    return out.select(
        "n_tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("t_all") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        F.col("t_all").alias("total_tokens"), F.col("d_all").alias("total_docs"),
        ((F.col("d_all") - docs_from + F.col("docs")) / F.col("d_all")).alias("share_upto"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at ``limit``."""
    row = sums.where(F.col("n_tokens") > limit).orderBy("n_tokens").select(
        "docs_from", "tokens_from", "total_tokens").head()
    if row is None:
        return (sums.agg(F.max("total_tokens")).head()[0] or 0)
    return row.total_tokens - row.tokens_from + limit * row.docs_from


def length_quantile(sums: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("share_upto") >= share).agg(F.min("n_tokens")).head()[0]


def token_counts(df: DataFrame, path: str | None = None) -> DataFrame:
    """Sums for every length that occurs; the histogram is stored, as it has two consumers."""
    return suffix_sums(materialize(histogram(token_lengths(df, path)), "lengths"))
