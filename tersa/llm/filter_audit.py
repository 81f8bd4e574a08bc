"""Filter interaction audit (operator 12).

Five filters, A to E, are applied to whole texts in each of their 120 orders; the
audit tells what every step keeps and removes, what an earlier filter has taken
already, and each filter's share over all orders.

A document's failures are one mask of five bits. Orders that begin with the same
letters have consecutive ranks (an order's rank is its Lehmer code read in the
factorial number system), so the orders in which a mask is removed at a step are a
few intervals of ranks: filters that the mask passes, then one that it fails. Counts of each mask are
added where an interval begins, subtracted where it ends, and summed up along the
120 ranks. Work after the scan depends on masks and parts, not on documents.

Only SQL functions. One scan makes a narrow row of each text (failures A to D and
a SHA-256 of the text). Copies of a text become one record per part by partial sums
before anything is compared, so no text is a hot key; filter E takes the smallest
id among those few records.

A null text counts as empty, a null part as the empty string. A text without words
fails A alone (B and C compare 0 with 0). E: a row fails if a smaller id has the
same text; rows with one id do not fail through each other, and rows with a null id
neither fail nor make others fail. Repeated rows count each. A document is good, or
toxic, if any label row of its id says so; null ids have no labels. Other columns are
not read. Without documents there are no parts and the result is empty.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
# Separators of words, limits of the filters A to D.
GAPS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def lehmer_rank(prefix: str, letters: str = FILTERS) -> int:
    """Rank of the first order of ``letters`` that begins with ``prefix``."""
    rank, left = 0, sorted(letters)
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def intervals(letters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first rank, rank after the last)`` of every removal.

    At ``step`` a mask is removed by a letter it holds, after letters it does not.
    """
    out = []
    for mask in range(1, 1 << len(letters)):
        failed = [x for i, x in enumerate(letters) if mask >> i & 1]
        passed = [x for x in letters if x not in failed]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for letter in failed:
                    low = lehmer_rank("".join(before) + letter, letters)
                    out.append((mask, step, low, low + factorial(len(letters) - step)))
    return out


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def text_failures(df: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, text_key, mask`` of every row; the mask holds failures A to D."""
    texts = df.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                      F.coalesce("text", F.lit("")).alias("t"))
    words = texts.withColumn("w", F.array_remove(F.split("t", GAPS), ""))
    sized = words.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("text_key"),
        F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d"),
        F.length("t").alias("chars"), F.length(F.translate("t", CAPITALS, "")).alias("other"),
        F.col("t").rlike(MARKS).alias("marked"))
    n, d, chars = F.col("n"), F.col("d").cast("long"), F.col("chars").cast("long")
    bits = (_bit(n < LEAST_WORDS, "A"),
            _bit(100 * d < LEAST_DISTINCT_PERCENT * n.cast("long"), "B"),
            _bit(100 * (chars - F.col("other")) > MOST_CAPITALS_PERCENT * chars, "C"),
            _bit(F.col("marked"), "D"))
    return sized.select("doc_id", "part", "text_key",
                        reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each mask, all five filters in it."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    rows = text_failures(docs, part)
    marked = rows.where("doc_id is not null").join(told, "doc_id", "left").select(
        *rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # Rows of one id and text first, then one record per text, part and labels.
    record = ["text_key", "part", "mask", "good", "toxic"]
    copies = marked.groupBy("doc_id", *record).agg(F.count("*").alias("n")).groupBy(*record).agg(
        F.sum("n").alias("all"), F.min(F.struct("doc_id", "n")).alias("first"))
    same_text = Window.partitionBy("text_key")  # at most four records of a part
    smallest = F.col("first.doc_id") == F.min("first.doc_id").over(same_text)
    split = copies.select(
        *record[1:], "all", F.when(smallest, F.col("first.n")).otherwise(0).alias("once"))
    repeated = 1 << FILTERS.index("E")
    halves = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("once").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(repeated)).alias("mask"),
                 (F.col("all") - F.col("once")).alias("n")))))
    nameless = rows.where("doc_id is null").select(
        "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask",
        F.lit(1).cast("long").alias("n"))
    return halves.where("n > 0").unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
                                 for c in ("good", "toxic")])


def orders(letters: str = FILTERS) -> list[str]:
    """All orders; the place of each is its rank."""
    return ["".join(p) for p in permutations(sorted(letters))]


def audit(counts: DataFrame) -> DataFrame:
    """The audit of mask counts as ``mask_counts`` gives them."""
    spark, every, steps = counts.sparkSession, orders(), range(1, len(FILTERS) + 1)
    measures = ("n", "good", "toxic")
    # A few dozen records a part: from here on, a part stays where it is.
    cells = counts.repartition("part")
    where = F.broadcast(spark.createDataFrame(
        intervals(), "mask int, step int, low int, high int"))  # 840 rows, whatever the data
    ends = cells.join(where, "mask").select("part", "step", F.inline(F.array(*[
        F.struct(F.col(at).alias("rank"), *[(sign * F.col(c)).alias(c) for c in measures])
        for at, sign in (("low", 1), ("high", -1))])))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0))
             for i in range(len(FILTERS))]
    alone = [F.sum(F.when(F.col("mask") == (1 << i), F.col("n")).otherwise(0))
             for i in range(len(FILTERS))]
    parts = cells.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"),
                                      F.array(*alone).alias("alone"))
    zeros = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(steps[-1]))).alias("step")) \
        .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))).alias("rank"),
                *[F.lit(0).cast("long").alias(c) for c in measures])
    along = Window.partitionBy("part", "step").orderBy("rank")
    sums = ends.where(F.col("rank") < len(every)).unionByName(zeros).groupBy(
        "part", "step", "rank").agg(*[F.sum(c).alias(c) for c in measures]).select(
        "part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in measures])
    order = F.element_at(F.array(*map(F.lit, every)), F.col("rank") + 1)
    told = sums.join(parts, "part").withColumn("filter_order", order).withColumn(
        "letter", F.ascii(F.substr("filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0]))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    return told.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.get("fails", F.col("letter")) - F.col("n")).alias("redundant"),
        F.get("alone", F.col("letter")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, filter order and step; ``labels`` has ``doc_id, quality, toxic``."""
    return audit(mask_counts(docs, labels, part))
