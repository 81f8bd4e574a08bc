"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two bigram models, of toxic and of ordinary text, share their last backoff: the
continuation counts over the whole corpus. A text's score compares its
two log-likelihoods, each divided by the length, on a logistic scale.

The continuation counts are gathered from every document: distinct pairs of
neighbouring words, counted by second word, divided by all of them. The class counts come from a
bounded sample of labelled rows, ``PER_CLASS`` toxic texts at most and up to
``ORDINARY`` ordinary ones for each, so what the workers get is bounded by the
sample: its pairs and words that outlive the discount, and their shared backoff.
A word that neither class knows, alone or as the second of a pair, takes its
probability from the shared counts in both models, where it cancels, so the
corpus-wide value is only needed for the words that one of them knows.

A null or wordless text has likelihoods of 0 and gets the score of that
difference. With fewer than four texts of a class every score is half the share
of toxic ones. Labels of null ids are not used; if an id has several labels, the
largest counts. Repeated rows come out repeated; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, per_text, slices, small_batches, sums, unmix64, words_of

#: Toxic texts that the class counts are taken from, and ordinary ones for each of them.
PER_CLASS, ORDINARY = 1_500, 4
#: Characters of a text beyond which it is not part of the sample.
SAMPLE_CHARS = 50_000
DISCOUNT = 4.0
#: Words whose two probabilities are closer than this (as logarithms) count as alike in both
#: classes: so much may come from the mix of topics and languages of the sample.
TIE = 2.25
#: Words without evidence that every text is thought to have besides its own.
PRIOR_WORDS = 20
#: Difference of likelihoods a word from which on the scale is logarithmic.
UNIT = 0.01
#: Bytes of text whose word pairs are told apart in one group.
GROUP_BYTES = 8 << 20
#: A text without evidence for either class stays on the ordinary side of the scale.
LEAST_MIDDLE = 0.4


def word_keys(values: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v) for v in values), np.uint64, len(values))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first) + second)


def neighbours(starts: np.ndarray, count: int) -> np.ndarray:
    """Positions of words that have another word of their text before them."""
    inner = np.ones(count, bool)
    inner[starts[:-1][starts[:-1] < count]] = False
    return np.flatnonzero(inner)


def packed(codes: np.ndarray, bits: int):
    """Sorted codes as differences of as few bytes as needed, by their first ``bits`` bits.

    Bytes of one place come together: those of the highest are nearly all 0.
    """
    codes = np.unique(codes)
    group = (codes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(codes), int)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    step = np.diff(codes, prepend=np.uint64(0))
    step[first] = codes[first]
    for start, end in zip(first, np.append(first[1:], len(codes)), strict=True):
        width = max(1, -(-int(step[start + 1:end].max(initial=0)).bit_length() // 8))
        rest = step[start + 1:end].view(np.uint8).reshape(-1, 8)[:, :width].T
        yield int(group[start]), codes[start].tobytes() + bytes([width]) + rest.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    step = np.zeros((1 + (len(data) - 9) // data[8], 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8)
    step[1:, :data[8]] = np.frombuffer(data, np.uint8, offset=9).reshape(data[8], -1).T
    return step.view(np.uint64).ravel().cumsum(dtype=np.uint64)


def continuations(df: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int, int]:
    """How many different words stand before each of the ``known`` words, over all texts.

    Also the distinct pairs of all words, known or not, which is what the counts
    are divided by, and all words that have one before them.

    A pair is one number: place of a known word and hash of the word before it, or
    else a hash of both. Pairs are thinned to distinct ones in every slice, then in
    groups of their mixed bits, so a frequent word is no hot key. The groups grow in
    number with the text, and the counts per word are partial sums.
    """
    size = df.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(0, (size // GROUP_BYTES).bit_length())
    shared = df.sparkSession.sparkContext.broadcast(known)

    def step(batch, texts):
        starts, codes, values = words_of(texts)
        keys, known = word_keys(values), shared.value
        at = neighbours(starts, len(codes))
        if not len(at):
            return None
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[place] == keys
        before, after = codes[at - 1], codes[at]
        low = mix64(keys) & np.uint64((1 << 40) - 1)
        pair = np.where(hit[after], place[after].astype(np.uint64) << np.uint64(40) | low[before],
                        pair_keys(keys[before], keys[after]) | np.uint64(1 << 63))
        group, data = zip(*packed(mix64(pair), bits), strict=True)
        words = np.zeros(len(group), np.int64)
        words[0] = len(at)
        return [np.array(group, np.int64), pa.array(data, pa.binary()), words]

    def count(table: pa.Table) -> pa.Table:
        known = shared.value
        pair = unmix64(np.unique(np.concatenate([unpacked(x.as_py()) for x in table["data"]])))
        place = (pair[pair < np.uint64(1 << 63)] >> np.uint64(40)).astype(np.int64)
        place, n = np.unique(place, return_counts=True)
        return pa.table({"place": np.append(place, [len(known), len(known) + 1]),
                         "n": np.append(n, [len(pair), pc.sum(table["words"]).as_py()])})

    found = per_text(df.select("text"), step, "g long, data binary, words long").groupBy(
        "g").applyInArrow(count, "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(known) + 2)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    return counts[:-2], int(counts[-2]), int(counts[-1])


def continuation_counts(df: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of the ``known`` words as in ``continuations``, and all words with one before them."""
    counts, _, words = continuations(df, known)
    return counts, words


def class_counts(train: DataFrame, discount: float) -> list:
    """Counts of both classes of ``train(toxic, text)``, aggregated by Spark.

    Only what outlives the discount reaches the driver.
    """
    def step(batch, texts):
        starts, codes, values = words_of(texts)
        keys = word_keys(values)[codes]
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        at = neighbours(starts, len(keys))
        second = np.zeros(len(keys), bool)  # the second word of a text has one word before it
        second[starts[:-1][np.diff(starts) > 1] + 1] = True
        ahead = np.where(second[at], np.uint64(0), keys[at - 2])
        return [batch.column("toxic").take(pa.array(row[at])), *[
            x.view(np.int64) for x in (ahead, keys[at - 1], keys[at])]]

    kept = F.greatest(F.col("n") - discount, F.lit(0.0))
    pairs = materialize(
        per_text(train, step, "toxic boolean, ahead long, before long, after long")
        .distinct().groupBy("toxic", "before", "after").agg(F.count("*").alias("n")), "pairs")
    tables = {
        "pair": pairs.where(kept > 0).select("toxic", "before", "after", kept.alias("kept")),
        "history": pairs.groupBy("toxic", "before").agg(
            F.sum("n").alias("n"), F.sum(kept).alias("kept")).where("kept > 0"),
        "word": pairs.groupBy("toxic", "after").agg(F.count("*").alias("n")).where(kept > 0)
        .select("toxic", "after", kept.alias("kept")),
    }
    tables = {k: t.toArrow().to_pandas() for k, t in tables.items()}
    kinds = {r.toxic: r["count"] for r in pairs.groupBy("toxic").count().collect()}
    return [Counts({k: t[t.toxic == c] for k, t in tables.items()}, kinds.get(c, 1))
            for c in (True, False)]


class Counts:
    """Bigram counts of one class, over hashed words.

    Pairs count once for each different word before them, and words once for each
    different word before them, as in the lower orders of a trigram model: a
    passage that many texts repeat counts once. The discount is wider than one: an
    expression after up to ``DISCOUNT`` words leaves all its mass to the backoff.
    """

    def __init__(self, tables: dict, kinds: int):
        def hashes(table, name):
            return table[name].to_numpy().view(np.uint64)

        def ordered(keys, *values):
            by = np.argsort(keys)
            return keys[by], *[v.to_numpy().astype(float)[by] for v in values]

        pair, history, word = tables["pair"], tables["history"], tables["word"]
        self.pair, self.kept = ordered(
            pair_keys(hashes(pair, "before"), hashes(pair, "after")), pair.kept)
        #: Words whose shared value does not cancel: known alone, or in a pair that is kept.
        self.known = np.union1d(hashes(word, "after"), hashes(pair, "after"))
        self.history, self.history_n, self.history_kept = ordered(
            hashes(history, "before"), history.n, history.kept)
        self.word, self.word_kept = ordered(hashes(word, "after"), word.kept)
        self.kinds = float(kinds)
        self.share = 1 - self.word_kept.sum() / self.kinds

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], 0.0)

    def word_probability(self, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Continuation probability in this class, backed off to the shared one."""
        return self._find(self.word, words, self.word_kept) / self.kinds + self.share * shared

    def history_terms(self, words: np.ndarray):
        """Counts of words as histories, and the weight of the backoff after them."""
        n = np.maximum(self._find(self.history, words, self.history_n), 1)
        return n, 1 - self._find(self.history, words, self.history_kept) / n


class Model:
    """Both classes, the shared backoff and the logistic scale."""

    def __init__(self, toxic: Counts, ordinary: Counts, words, shared, floor: float):
        self.classes, self.words, self.shared, self.floor = (toxic, ordinary), words, shared, floor
        self.slope, self.middle, self.tie = 1.0, 0.0, TIE

    def log_ratio(self, texts) -> np.ndarray:
        """Difference of the length-normalised log-likelihoods of each text, on a flat scale."""
        starts, codes, values = words_of(texts)
        keys = word_keys(values)
        shared = np.maximum(Counts._find(self.words, keys, self.shared), self.floor)
        at = neighbours(starts, len(codes))
        before, after = codes[at - 1], codes[at]
        pairs = pair_keys(keys[before], keys[after])
        ratio = np.zeros(len(codes))
        opening = np.setdiff1d(np.arange(len(codes)), at, assume_unique=True)
        for sign, side in zip((1, -1), self.classes, strict=True):
            alone = side.word_probability(keys, shared)
            n, weight = side.history_terms(keys)
            seen = Counts._find(side.pair, pairs, side.kept)
            ratio[at] += sign * np.log(seen / n[before] + weight[before] * alone[after])
            ratio[opening] += sign * np.log(alone[codes[opening]])
        # Few toxic texts are known: that they lack a word says nothing.
        known = Counts._find(self.classes[0].word, keys, self.classes[0].word_kept)[codes] > 0
        ratio[(np.abs(ratio) < self.tie) | (ratio < 0) & ~known] = 0.0
        return np.arcsinh(sums(ratio, starts) / (np.diff(starts) + PRIOR_WORDS) / UNIT)

    def score(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * (self.log_ratio(texts) - self.middle)).clip(-30, 30)))


def _scale(model: Model, values: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic scale of held-back texts of the sample, with a weak pull to a steady slope."""
    spread = max(float(values.std()), 1e-6)
    z, w, b = (values - values.mean()) / spread, 1.0, 0.0
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    for _ in range(2_000):
        p = 1 / (1 + np.exp(-(w * z + b)))
        g = weight * (p - toxic)
        w, b = w - 2.0 * ((g * z).sum() + 1e-4 * w), b - 2.0 * g.sum()
    model.slope = max(w, 0.1) / spread
    model.middle = max(values.mean() - b / model.slope, LEAST_MIDDLE)


def fit(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """Learn from ``labels(doc_id, toxic)`` and, for the shared backoff, from every text.

    Three quarters of the sample give the class counts, the rest the scale.
    Returns the share of toxic labels if one class is missing.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    most = F.when(F.col("toxic") == 1, per_class).otherwise(ORDINARY * per_class)
    order = Window.partitionBy(F.col("toxic") == 1).orderBy(F.xxhash64("doc_id"), "doc_id")
    passing = F.lit(False)
    for r in marks.groupBy((F.col("toxic") == 1).alias("t")).count().collect():
        # A share of the hashes passes first, so that no task ranks all labels of a class.
        share = min(1.0, 8 * (1 if r.t else ORDINARY) * per_class / r["count"])
        passing |= ((F.col("toxic") == 1) == r.t) & (
            F.xxhash64("doc_id") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    chosen = marks.where(passing).withColumn("n", F.row_number().over(order)).where(
        (F.col("n") <= 2 * ORDINARY * per_class) & (F.col("n") <= 2 * most)).select(
        "doc_id", "toxic")
    # At most 2 * (1 + ORDINARY) * per_class short rows; half of them may have long texts.
    rows = df.select("doc_id", "text").where(
        F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    sample = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(
        (F.col("toxic") == 1).alias("toxic"), "text", F.row_number().over(order).alias("n")),
        "sample").where(F.col("n") <= F.when(F.col("toxic"), per_class).otherwise(
            ORDINARY * per_class))
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if min(size.get(True, 0), size.get(False, 0)) < 4:
        return size.get(True, 0) / max(1, sum(size.values()))
    size[False] = min(size[False], ORDINARY * size[True])
    most, learnt = (F.when(F.col("toxic"), n[True]).otherwise(n[False]) for n in (
        size, {c: 3 * n // 4 for c, n in size.items()}))
    counts = class_counts(sample.where(F.col("n") <= learnt).select("toxic", "text"), DISCOUNT)
    known = np.union1d(*[c.known for c in counts])
    if not len(known):
        return size[True] / sum(size.values())
    shared, total, _ = continuations(df, known)
    model = Model(*counts, known, shared / max(total, 1), 0.5 / max(total, 1))
    held = sample.where((F.col("n") > learnt) & (F.col("n") <= most)).select("toxic", "text")
    way = df.sparkSession.sparkContext.broadcast(model)
    rows = per_text(held, lambda batch, texts: [batch.column("toxic"),
                                                way.value.log_ratio(texts)],
                    "toxic boolean, value double").orderBy("toxic", "value").collect()
    _scale(model, np.array([r.value for r in rows]), np.array([r.toxic for r in rows]))
    return model


def _scorer(df: DataFrame, model: Model | float):
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(texts) -> np.ndarray:
        if isinstance(shared.value, float):
            return np.full(len(texts), shared.value / 2)
        return shared.value.score(texts)

    return score


def score_texts(df: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of every row."""
    score = _scorer(df, model)
    return per_text(df.select("doc_id", "text"),
                    lambda batch, texts: [batch.column("doc_id"), score(texts)],
                    "doc_id long, score double")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"


def toxicity(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Learn from the labels that are not held out, score every row."""
    model = fit(df, labels.where(f"not {HELD_OUT}"), per_class)
    return score_texts(df, model).selectExpr(
        "doc_id", f"{HELD_OUT} AS held_out", "score", "cast(score >= 0.5 as int) AS predicted")


def keep_ordinary(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``df`` whose text scores below one half; columns stay as they are."""
    score = _scorer(df, fit(df, labels.where(f"not {HELD_OUT}")))

    def run(batches):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            yield batch.filter(pa.array(score(texts) < 0.5))

    return df.mapInArrow(run, df.schema)
