"""N-gram Jaccard join (operator 3).

All pairs of texts whose sets of five-word shingles have a Jaccard similarity of
at least 0.8, by Bayesian pruning of candidates: MinHash values are compared in
steps, a pair is dropped once the posterior probability of reaching the threshold
falls below ``TOLERANCE``, and what is left is verified on the sets themselves.

1. Texts with equal sets become one representative with a number of copies.
2. Representatives that agree in a band of MinHash values are candidates. They
   are gathered in blocks of bounded size: those that share bands get a common
   label, and a label's members are dealt into as many blocks as they need.
3. Two blocks meet if a band occurs in both; a task compares the members of one
   pair of blocks. It returns a row per member (how many links, and one member
   of the same local component), never the pairs, so a large group of near copies
   costs tasks, not rows.
4. Components of these rows are the classes.

Words are lower-cased runs of letters and digits. A text of one to four words is
one shingle of all its words. A null or wordless text has no shingles: it is a
class of its own, without links. A row whose id is null is joined like any other;
a class is named by its smallest id, null if all are null. Rows alike in id and
text are copies of each other. Other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import attach
from .common import materialize, mix64, per_text, words_of
from .toxicity import word_keys

WORDS, THRESHOLD = 5, 0.8
#: MinHash values, rows of a band (24 bands of 4 miss 3 pairs in a million at 0.8), and a step.
HASHES, BAND, STEP = 96, 4, 16
TOLERANCE = 1e-6
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 150_000
#: Keys up to which a filter on texts is broadcast; with more it is a shuffled join.
BROADCAST_KEYS = 1_000_000

_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) \
    | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Distinct shingle hashes of each text, one text after the other, and where each begins."""
    starts, codes, values = words_of(texts)
    keys = word_keys(values)[codes]
    size = np.diff(starts)
    rolled = mix64(keys[:max(0, len(keys) - words + 1)])
    for j in range(1, words):
        rolled = mix64(rolled + keys[j:len(keys) - words + 1 + j])
    rows = []
    for i in range(len(size)):
        a, n = starts[i], size[i]
        if n >= words:
            rows.append(np.unique(rolled[a:a + n - words + 1]))
        else:
            h = np.full(1, n, np.uint64)
            for k in keys[a:a + n]:
                h = mix64(h + k)
            rows.append(h if n else h[:0])
    return np.concatenate(([0], np.cumsum([len(r) for r in rows]))), \
        np.concatenate(rows) if rows else np.zeros(0, np.uint64)


def minhash(begin: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` smallest values of 32 bits for each set; sets must not be empty."""
    out = np.empty((len(begin) - 1, HASHES), np.uint32)
    for k, seed in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat((hashes * seed) >> np.uint64(32), begin[:-1])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(len(values), -1, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for j in range(BAND):
        h = mix64(h + rows[:, :, j] + np.uint64(1))
    return h


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Fewest matches after each step that leave the threshold likely enough.

    With a uniform prior, the similarity of a pair with m matches among n values
    exceeds t with probability P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def similar_pairs(begin, hashes, values, left, right, threshold: float, least: list[int]):
    """Pairs of ``left`` x ``right`` (positions) at the threshold, each pair once."""
    a, b = values[left], values[right]
    same = (a[:, None, :STEP] == b[None, :, :STEP]).sum(axis=2)
    i, j = np.nonzero((same >= least[0]) & (left[:, None] < right[None, :]
                                            if left is right else True))
    count = same[i, j]
    for step, need in enumerate(least[1:], 1):
        part = slice(step * STEP, (step + 1) * STEP)
        count = count + (a[i, part] == b[j, part]).sum(axis=1)
        kept = count >= need
        i, j, count = i[kept], j[kept], count[kept]
    if not len(i):
        return left[i], right[j]
    size = np.diff(begin)
    names, code = np.unique(hashes, return_inverse=True)
    if (len(left) + len(right)) * len(names) <= 12_000_000:
        table = np.zeros((len(size), len(names)), np.float32)
        table[np.repeat(np.arange(len(size)), size), code] = 1
        common = np.rint((table[left] @ table[right].T)[i, j])
    else:
        sets = [code[s:e] for s, e in zip(begin[:-1], begin[1:], strict=True)]
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                           for x, y in zip(left[i], right[j], strict=True)])
    union = size[left[i]] + size[right[j]] - common
    good = common >= threshold * union - 1e-9
    return left[i[good]], right[j[good]]


def signatures(df: DataFrame) -> DataFrame:
    """``doc_id, k, h, node, shingles, bands``: ``node`` names the set, null if it is empty."""
    def step(batch, texts):
        begin, hashes = shingle_sets(texts)
        size = np.diff(begin)
        some = np.flatnonzero(size)
        node, bands = np.full(len(size), None, object), np.full(len(size), None, object)
        if len(some):
            at = np.append(begin[:-1][some], begin[-1])
            one = np.add.reduceat(hashes, at[:-1])
            two = np.add.reduceat(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[:-1])
            raw = np.column_stack([mix64(one), mix64(two + size[some].astype(np.uint64))])
            node[some] = [r.tobytes() for r in raw]
            for i, b in zip(some, band_keys(minhash(at, hashes)).view(np.int64), strict=True):
                bands[i] = b
        return [*(batch.column(c) for c in ("doc_id", "k", "h")), pa.array(node, pa.binary()),
                size.astype(np.int64), pa.array(bands, pa.list_(pa.int64()))]

    return per_text(df.select("doc_id", "text", *row_key()), step,
                    "doc_id long, k long, h long, node binary, shingles long, bands array<long>")


def row_key() -> list:
    """Columns that find a row of the table again, also if its id is null."""
    return [F.coalesce("doc_id", F.lit(-1)).cast("long").alias("k"),
            F.xxhash64("text", "doc_id").alias("h")]


def _candidates(nodes: DataFrame) -> DataFrame:
    """``band, node, head`` of the bands that more than one representative has."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialize(bands.groupBy("band").agg(
        F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "shared")
    return materialize(attach(bands, shared, ["band"], "n").select("band", "node", "head"),
                       "bands")


def _blocks(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """``node, block, copies, k, h`` of all candidates."""
    label = bands.groupBy("node").agg(F.min("head").alias("label"))
    lower = materialize(bands.join(label, "node").groupBy("band").agg(
        F.min("label").alias("label"), F.count("*").alias("n")), "lower")
    label = attach(bands.select("band", "node"), lower, ["band"], "n").groupBy("node").agg(
        F.min("label").alias("label"))
    rows = materialize(nodes.join(label, "node").select(
        "node", "label", "copies", "shingles", "k", "h"), "labels")
    parts = materialize(rows.groupBy("label").agg(F.count("*").alias("n"), F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)
    ).alias("parts")), "parts")
    return materialize(attach(rows, parts, ["label"], "n").select(
        "node", "copies", "k", "h",
        F.xxhash64("label", F.expr("pmod(xxhash64(node), parts)")).alias("block")), "blocks")


def _meetings(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """``meeting, block``: the one or two blocks of each pair that is to be compared."""
    within = blocks.groupBy("block").count().where("count > 1").select(
        F.col("block").alias("one"), F.col("block").alias("two"))
    held = bands.join(blocks.select("node", "block"), "node").select("band", "block").distinct()
    several = materialize(held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"),
                          "several")
    held = materialize(attach(held, several, ["band"], "n").select("band", "block"), "held")
    across = held.select("band", F.col("block").alias("one")).join(
        held.select("band", F.col("block").alias("two")), "band").where("one < two").select(
        "one", "two").distinct()
    pairs = within.unionByName(across)
    return pairs.select(F.struct("one", "two").alias("meeting"),
                        F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))


def _texts(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """``node, block, copies, text``: the text of each candidate, once."""
    rows = df.select("text", *row_key())
    if blocks.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(blocks.select("k", "h")), ["k", "h"], "left_semi")
    return rows.dropDuplicates(["k", "h"]).join(blocks, ["k", "h"])


def linked(df: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD,
           tolerance: float = TOLERANCE) -> DataFrame:
    """``node, links, root`` of each member of each meeting that has links there.

    ``links`` counts the rows of the table behind its partners, ``root`` is one
    member of its component in the meeting.
    """
    bands = _candidates(nodes)
    blocks = _blocks(nodes, bands)
    least = least_matches(threshold, tolerance)
    texts = materialize(_texts(df, blocks).select("node", "block", "copies", "text"), "texts")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        begin, hashes = shingle_sets(pc.fill_null(table["text"].combine_chunks(), ""))
        values = minhash(begin, hashes)
        block = table["block"].to_numpy()
        left = np.flatnonzero(block == block[0])
        right = np.flatnonzero(block != block[0])
        one, two = similar_pairs(begin, hashes, values, left, right if len(right) else left,
                                 threshold, least)
        copies = table["copies"].to_numpy()
        links = np.bincount(one, copies[two], len(block)) + np.bincount(two, copies[one], len(block))
        root = np.arange(len(block))
        while True:  # smallest member of each local component
            low = root.copy()
            np.minimum.at(low, one, root[two])
            np.minimum.at(low, two, root[one])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(links)
        return pa.table({"node": table["node"].take(pa.array(some)),
                         "links": pa.array(links[some].astype(np.int64)),
                         "root": table["node"].take(pa.array(root[some]))})

    met = _meetings(blocks, bands).join(texts, "block")
    return materialize(met.groupBy("meeting").applyInArrow(
        compare, "node binary, links long, root binary"), "linked")


def _classes(df: DataFrame, threshold: float, tolerance: float):
    """Signatures of all rows, and ``node, copies, class, links`` of all sets."""
    rows = materialize(signatures(df), "signatures")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("low"),
        F.min(F.struct("k", "h", "shingles", "bands")).alias("pick")).select(
        "node", "copies", "low", "pick.*"), "nodes")
    found = linked(df, nodes, threshold, tolerance)
    component = connected_components(found.where("node <> root").select(
        F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.drop("bands", "shingles").join(
        component.withColumnRenamed("row_id", "node"), "node", "left").join(
        links, "node", "left")
    return rows, materialize(named.select(
        "node", "copies", "low", "k", "h", F.coalesce("group_id", "node").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")


def jaccard_join(df: DataFrame, threshold: float = THRESHOLD,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row: links count the other rows at the threshold."""
    rows, classes = _classes(df, threshold, tolerance)
    low = classes.groupBy("class").agg(F.min("low").alias("class_id"))
    named = materialize(classes.join(low, "class").select("node", "copies", "class_id", "links"),
                        "named")
    out = attach(rows.where("node is not null").select("doc_id", "node"), named, ["node"],
                 "copies").select("doc_id", "class_id", F.col("links").alias("n_links"))
    return out.unionByName(rows.where("node is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(df: DataFrame, threshold: float = THRESHOLD,
                tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of ``df`` without all but one of each class; columns stay as they are.

    The row with the smallest id stays (a null id counts as -1). Rows without
    words stay. Of rows alike in id and text one stays, whichever.
    """
    rows, classes = _classes(df, threshold, tolerance)
    stay = classes.groupBy("class").agg(F.min(F.struct("k", "h")).alias("s")).select("s.*")
    worded = rows.where("node is not null").groupBy("k", "h").agg(F.count("*").alias("n"))
    flags = materialize(worded.join(stay.withColumn("stays", F.lit(True)), ["k", "h"], "left")
                        .where("stays is null or n > 1"), "flags")
    names = [_unused(df, "k"), _unused(df, "h")]
    keyed = df.withColumns(dict(zip(names, row_key(), strict=True)))
    gone = flags.select("k", "h").toDF(*names)
    few = F.broadcast(gone) if flags.count() <= BROADCAST_KEYS else gone
    kept = keyed.join(few, names, "left_anti")
    again = flags.where("stays").select("k", "h").toDF(*names)
    if not again.isEmpty():
        kept = kept.unionByName(keyed.join(again, names, "left_semi").dropDuplicates(names))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
