"""Best-fit packing (operator 7).

Best-fit decreasing over all pieces of all documents. Pieces of one length are
alike, so the packing is planned on the histogram of lengths (at most
``capacity`` entries, whatever the data): for each length, longest first, a
segment tree over remaining capacities names the tightest open bins, and a whole
run of pieces goes into them at once. The result is the one that placing piece
after piece gives. A piece then finds its bin from its rank among the pieces of
its length; hot lengths are ranked in salted parts whose counts are summed up.

A null text is an empty document: one piece that holds the end id alone. Rows
with equal or null ``doc_id`` are packed each on its own; other columns are not
read. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding
from .common import materialize, per_text

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together.
PART_ROWS = 20_000


def cut(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
        path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; only documents over ``capacity`` are cut."""
    path = path or encoding.default_path("byte_bpe_50k.tiktoken")
    end = np.array([end_id], "<u4").tobytes()

    def step(batch, texts):
        at, ids = encoding.encode(texts, path)
        raw = memoryview(ids.astype("<u4").tobytes())
        n = at[1:] - at[:-1] + 1
        first = np.where(n <= capacity, n, (n - 1) % capacity + 1)
        pieces = (n - first) // capacity + 1
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[row], capacity)
        begin, last = at[:-1][row] + start, piece == pieces[row] - 1
        crc = [
            zlib.crc32(end, zlib.crc32(raw[4 * b:4 * (b + k - 1)])) if z
            else zlib.crc32(raw[4 * b:4 * (b + k)])
            for b, k, z in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)]
        return [batch.column("doc_id").take(pa.array(row)), piece.astype(np.int32),
                start.astype(np.int64), length.astype(np.int64), np.array(crc, np.int64)]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, piece int, start long, length long, ids_crc32 long")


class Capacities:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` that an open bin has."""
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Runs ``(length, rank, rank_end, per_bin, bin, offset)`` of best-fit decreasing.

    The pieces of a length with ranks from ``rank`` go ``per_bin`` to a bin into
    the bins from ``bin`` on, the first of each bin at ``offset``. A bin that is
    the tightest stays the tightest until the length no longer fits, so the run
    is what one piece after another gives.
    """
    open_bins, tree, runs, bins = defaultdict(list), Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                low, high = bins, bins + -(-left // per)
                bins = high
            else:
                low, high = open_bins[room].pop()
                per = room // length
                tree.add(room, low - high)
            placed = min(left, per * (high - low))
            full, rest = divmod(placed, per)
            runs.append((length, rank, rank + placed, per, low, capacity - room))
            for a, b, used in ((low, low + full, per * length),
                               (low + full, low + full + bool(rest), rest * length),
                               (low + full + bool(rest), high, 0)):
                if a < b:
                    open_bins[room - used].append((a, b))
                    tree.add(room - used, b - a)
            rank, left = rank + placed, left - placed
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which must be a stored table.

    Three passes over five short columns: the histogram, the counts of the
    salted parts, the ranks.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = plan(histogram, capacity)
    salts = spark.createDataFrame(
        [(k, -(-n // PART_ROWS)) for k, n in histogram.items()], "length long, parts long")
    order = ["doc_id", "piece", "ids_crc32"]
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "part", F.pmod(F.xxhash64(*order), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = salted.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(
        parts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # As many runs as there are lengths and shares of bins: thousands at most for 1024.
    table = spark.createDataFrame(
        runs, "length long, low long, high long, per long, bin long, base long")
    placed = ranked.join(F.broadcast(table), "length").where("rank >= low and rank < high")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("bin + (rank - low) div per").alias("sequence_id"),
        F.expr("base + (rank - low) % per * length").alias("offset"))


def best_fit(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
             path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``capacity`` tokens."""
    return pack(materialize(cut(df, capacity, end_id, path), "pieces"), capacity)
