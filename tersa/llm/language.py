"""Language ID by hierarchical discrimination (operator 5).

First the family of languages is predicted, then the language within it; at both
levels one-versus-one linear support vector machines vote. Features are hashed
letter 1-, 2- and 3-grams within the lower-cased words of the whole text, as
shares of all of them, so a text's margins are sums of what its words add: each
distinct word of a slice is looked at once.

The classifier is fitted on a bounded sample: ``PER_LANGUAGE`` different texts of
each ``lang`` value of the rows that may be learned from, ``MOST_LEARNT`` in all, of
the ``LANGUAGES`` commonest values. A text that is null or has no letter is ``und``
with score 0, and so is every text if there is nothing to learn from. Rows whose id is null are neither learned from nor held out.
Repeated rows come out repeated; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, slices, sums, words_of
from .sampling import smallest

# Families of languages by code. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"
NOT_LETTERS = r"\P{L}+"
PER_LANGUAGE = 250
#: Languages that are learned, and rows to learn from in all: one-versus-one machines grow by
#: the square of the languages of a family.
LANGUAGES, MOST_LEARNT = 128, 10_000
DIMENSIONS = 1 << 12
#: Numbers that letter 3-grams are hashed to, to tell which ones a language has.
KINDS_OF_GRAMS = 1 << 18
#: Learned rows held back to set what is rejected: one in so many, and the share of them that goes.
HELD_BACK, TAIL = 4, 0.002
#: Known 3-grams that every text is thought to have besides its own.
PRIOR_GRAMS = 20


def family_of(lang: str, families=None) -> str:
    return next((f for f, langs in (families or FAMILIES).items() if lang in langs), lang)


def grams(values: list[str]):
    """Hashed 1- to 3-grams of bytes of words: ``(gram, word)`` arrays, word starts and all."""
    raw = np.frombuffer(b" " + " ".join(values).encode() + b" ", np.uint8).astype(np.uint32)
    space = raw == 32
    word = np.cumsum(space) - 1
    one = raw * np.uint32(2654435761)
    two = (one[:-1] ^ raw[1:]) * np.uint32(2246822519)
    three = (two[:-1] ^ raw[2:]) * np.uint32(3266489917)
    # A gram may take in the space at an edge of its word, but not reach over it.
    inside = ((one, ~space), (two, np.ones(len(two), bool)), (three, ~space[1:-1]))
    gram = np.concatenate([h[keep] >> np.uint32(20) for h, keep in inside])
    return gram, np.concatenate([word[:len(h)][keep] for h, keep in inside])


def trigrams(values: list[str]):
    """Letter 3-grams of words under wider hashes: ``(gram, word)`` arrays."""
    raw = np.frombuffer(b" " + " ".join(values).encode() + b" ", np.uint8).astype(np.uint32)
    word = np.cumsum(raw == 32) - 1
    gram = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    keep = raw[1:-1] != 32
    return (gram * np.uint32(2654435761) >> np.uint32(14))[keep], word[1:-1][keep]


def _doc_trigrams(texts):
    """Distinct 3-grams of each text and how often it has them."""
    starts, codes, values = words_of(texts, NOT_LETTERS)
    gram, word = trigrams(values)
    begin = np.searchsorted(word, np.arange(len(values) + 1))
    for i in range(len(starts) - 1):
        own, n = np.unique(codes[starts[i]:starts[i + 1]], return_counts=True)
        size = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kinds, where = np.unique(gram[at], return_inverse=True)
        yield kinds.astype(np.int32), np.bincount(where, np.repeat(n, size), len(kinds))


def _doc_features(texts):
    """Gram counts per text, as dense rows one after the other."""
    starts, codes, values = words_of(texts, NOT_LETTERS)
    gram, word = grams(values)
    order = np.argsort(word, kind="stable")
    gram, word = gram[order], word[order]
    begin = np.searchsorted(word, np.arange(len(values) + 1))
    for i in range(len(starts) - 1):
        own, n = np.unique(codes[starts[i]:starts[i + 1]], return_counts=True)
        size = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield np.bincount(gram[at], np.repeat(n, size).astype(float), DIMENSIONS)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 25, seed: int = 5):
    """Linear support vector machine by dual coordinate descent; the bias is a column of ``x``."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(axis=1)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w)) / max(square[i], 1e-12)
            new = min(max(alpha[i] + step, 0.0), cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Pairwise machines over families, and over the languages of each family."""

    def __init__(self, counts: np.ndarray, langs: list[str], families=None):
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.scale = 1 / np.sqrt(share.mean(axis=0) + 1e-5) if len(share) else np.ones(DIMENSIONS)
        x = np.hstack([share * self.scale, np.ones((len(share), 1))])
        self.tree: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.tree.setdefault(family_of(lang, families), []).append(lang)
        own_family = np.array([family_of(v, families) for v in langs], object)
        own_lang = np.array(langs, object)
        self.groups, weights = [], []
        for labels, own in [(sorted(self.tree), own_family)] + [
                (v, own_lang) for _, v in sorted(self.tree.items())]:
            pairs = list(combinations(range(len(labels)), 2))
            self.groups.append((labels, pairs, len(weights)))
            for a, b in pairs:
                rows = (own == labels[a]) | (own == labels[b])
                weights.append(fit_svm(x[rows], np.where(own[rows] == labels[a], 1.0, -1.0)))
        table = np.array(weights) if weights else np.zeros((0, DIMENSIONS + 1))
        self.weights, self.bias = (table[:, :-1] * self.scale).T.copy(), table[:, -1]

    def _vote(self, margins: np.ndarray, group):
        """Winner of each row by votes, then by margins; and the sureness of its closest win."""
        labels, pairs, at = group
        score = np.zeros((len(margins), len(labels)))
        worst = np.full((len(margins), len(labels)), np.inf)
        for j, (a, b) in enumerate(pairs):
            m = margins[:, at + j]
            for side, v in ((a, m), (b, -m)):
                score[:, side] += (v > 0) + 1e-3 * np.tanh(v)
                worst[:, side] = np.minimum(worst[:, side], v)
        best = score.argmax(axis=1)
        sure = 1 / (1 + np.exp(-2 * worst[np.arange(len(margins)), best].clip(-50, 50)))
        return best, sure

    def predict(self, texts):
        """Language and score of each text."""
        starts, codes, values = words_of(texts, NOT_LETTERS)
        empty = starts[1:] == starts[:-1]
        lang, score = np.full(len(empty), UNKNOWN, object), np.zeros(len(empty))
        if not self.tree or not values:
            return lang, score
        gram, word = grams(values)
        row = np.repeat(np.arange(len(empty)), np.diff(starts))

        def total(of_word):
            return np.bincount(row, of_word[codes], len(empty))

        size = np.maximum(total(np.bincount(word, minlength=len(values)).astype(float)), 1)
        margins = np.column_stack([
            total(np.bincount(word, w[gram], len(values))) / size for w in self.weights.T]
            or [np.zeros((len(empty), 0))]) + self.bias
        return self.decide(margins, empty)

    def decide(self, margins: np.ndarray, empty: np.ndarray):
        """Language and score of rows by their margins."""
        lang, score = np.full(len(empty), UNKNOWN, object), np.zeros(len(empty))
        families = self.groups[0][0]
        family, sure = self._vote(margins, self.groups[0])
        for f, name in enumerate(families):
            mine = (family == f) & ~empty
            if mine.any():
                best, own = self._vote(margins[mine], self.groups[1 + sorted(self.tree).index(name)])
                lang[mine] = np.array(self.tree[name], object)[best]
                score[mine] = sure[mine] * own
        return lang, score


class Limits:
    """What a text must reach to have a language, from learned rows that were held back.

    A score, and a share of 3-grams that the predicted language does not have;
    ``TAIL`` of the held-back rows that are predicted right lie beyond each.
    """

    def __init__(self, least: float):
        self.score, self.strange, self.seen = least, 1.0, {}

    def learn(self, model: Model, learnt: list, held: list) -> None:
        for r in learnt:
            self.seen.setdefault(r.lang, np.zeros(KINDS_OF_GRAMS, bool))[
                np.frombuffer(r.kinds, np.int32)] = True
        counts = np.array([np.frombuffer(r.counts, np.float32) for r in held], float)
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        lang, score = model.decide(share @ model.weights + model.bias, np.zeros(len(held), bool))
        right = [i for i, r in enumerate(held) if r.lang == lang[i]]
        if not right:
            return
        strange = []
        for i in right:
            kinds, n = np.frombuffer(held[i].kinds, np.int32), np.frombuffer(held[i].n, np.float64)
            strange.append(n[~self.seen[lang[i]][kinds]].sum() / (n.sum() + PRIOR_GRAMS))
        self.score = max(self.score, float(np.quantile(score[right], TAIL)))
        self.strange = float(np.quantile(strange, 1 - TAIL))

    def passes(self, texts, lang: np.ndarray, score: np.ndarray) -> np.ndarray:
        kept = (lang != UNKNOWN) & (score >= self.score)
        if not self.seen or not kept.any():
            return kept
        starts, codes, values = words_of(texts, NOT_LETTERS)
        gram, word = trigrams(values)
        size = sums(np.bincount(word, minlength=len(values)).astype(float)[codes], starts)
        for name, seen in self.seen.items():
            mine = kept & (lang == name)
            if mine.any():
                new = np.bincount(word, ~seen[gram], len(values))
                share = sums(new[codes], starts) / (size + PRIOR_GRAMS)
                kept[mine] = share[mine] <= self.strange + 1e-12
        return kept


def _sample(df: DataFrame, per_language: int) -> DataFrame | None:
    """``lang, h, text`` of ``per_language`` different texts of each language: the smallest hashes.

    Of more than ``LANGUAGES`` values the commonest are learned. With more languages
    than ``MOST_LEARNT`` rows allow for, each has fewer rows.
    """
    rows = df.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(
        F.desc("count"), "lang").limit(LANGUAGES).collect()}
    wanted = max(1, min(per_language, MOST_LEARNT // max(1, len(sizes))))
    lettered = F.when(F.col("text").rlike("\\p{L}"), F.col("lang"))
    found = smallest(rows, lettered, sizes, wanted)
    return None if found is None else found.withColumnRenamed("side", "lang")


def _fitted(rows: list, families=None) -> Model:
    counts = np.array([np.frombuffer(r.counts, np.float32) for r in rows], float)
    return Model(counts.reshape(-1, DIMENSIONS), [r.lang for r in rows], families)


def fit(df: DataFrame, per_language: int = PER_LANGUAGE, families=None) -> Model:
    """Fit on ``per_language`` rows of each ``lang``, those with the smallest hashes of text."""
    def step(batch, texts):
        data = [v.astype(np.float32).tobytes() for v in _doc_features(texts)]
        return [batch.column("lang"), pa.array(data, pa.binary())]

    sample = _sample(df, per_language)
    found = [] if sample is None else per_text(
        sample.select("lang", "text"), step, "lang string, counts binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.counts)))
    return _fitted(found, families)


def fit_limits(df: DataFrame, least: float, per_language: int = PER_LANGUAGE):
    """A model of ``per_language`` rows of each language, and limits from further ones."""
    def step(batch, texts):
        data = [v.astype(np.float32).tobytes() for v in _doc_features(texts)]
        kinds, n = zip(*_doc_trigrams(texts), strict=True)
        return [batch.column("lang"), batch.column("h"), pa.array(data, pa.binary()), *[
            pa.array([v.tobytes() for v in x], pa.binary()) for x in (kinds, n)]]

    sample = _sample(df, per_language * HELD_BACK // (HELD_BACK - 1))
    found = [] if sample is None else per_text(
        sample, step, "lang string, h long, counts binary, kinds binary, n binary").collect()
    found.sort(key=lambda r: (r.lang, r.h))
    held = found[HELD_BACK - 1::HELD_BACK]
    learnt = [r for i, r in enumerate(found) if i % HELD_BACK < HELD_BACK - 1]
    model, limits = _fitted(learnt), Limits(least)
    if held:
        limits.learn(model, learnt, held)
    return model, limits


def identify(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batch, texts):
        lang, score = shared.value.predict(texts)
        return [batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), score]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, lang_pred string, score double")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


def language_id(df: DataFrame, per_language: int = PER_LANGUAGE, families=None) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    model = fit(df.where(f"doc_id is not null and not {HELD_OUT}"), per_language, families)
    return identify(df, model).selectExpr("doc_id", f"{HELD_OUT} AS held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.25) -> DataFrame:
    """Rows of ``df`` whose text has a language; columns stay as they are.

    A document is rejected if it is ``und``, if its score is below ``least`` or below
    that of nearly all learned rows, or if more of its 3-grams are strange to the
    language than in nearly all of them.
    """
    learnable = df.where(f"doc_id is not null and not {HELD_OUT}")
    shared = df.sparkSession.sparkContext.broadcast(fit_limits(learnable, least))

    def run(batches):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            model, limits = shared.value
            yield batch.filter(pa.array(limits.passes(texts, *model.predict(texts))))

    return df.mapInArrow(run, df.schema)
