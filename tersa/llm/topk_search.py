"""Exact top-k search by BM25 (operator 8).

The words of every text are told apart once: a pass writes shards of documents, in
order of length, as postings (word, document, frequency) to the shared folder, which
all later passes read. From a shard's postings a task builds an inverted index over
a query block's terms: impacts, the largest impact of each term, and of each
term within blocks of documents.

A term that many queries share and many documents hold costs more by its postings than
as a row of a matrix, so the scores of such terms come from one matrix product for
many queries (``MATRIX_TERMS`` terms at most). The other terms are left to block-max
WAND: with the score of the k-th best so far as threshold, only terms before the pivot
(those whose place the others cannot take) are read; the block maxima of the others
drop most of the documents that these propose; the rest is scored in full. The
products are of single precision, so documents are kept by a margin
(``MARGIN``) above what they may round; scores in full are of double precision.

Some of the shards are searched first. Their k-th best scores are thresholds for all
other shards, whose tasks return only what reaches them; within a task thresholds rise
from shard to shard. Impacts use global statistics (documents, mean length,
document frequencies), so the shards' lists merge exactly.

Queries run in blocks of ``BLOCK_QUERIES``, one pass over the shards for each
block; a block's terms, frequencies and thresholds are all that is broadcast.

Words are lower-cased runs of letters and digits; each distinct word of a query
counts once. Rows without id take no part. Query rows of one id are one query, with
the words of all; documents of its id are not among its results. Rows that repeat
another id are documents of their own. A query without words, or
whose words are nowhere else, has no results. Scores are ranked after rounding
to nine places, equal ones by id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, per_text, settle, slices, small_batches, words_of
from .toxicity import word_keys

K1, B = 1.2, 0.75
BLOCK_QUERIES, BLOCK_DOCS = 12_000, 64
#: Bytes of text and documents of a shard.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 16_384
PLACES, SLACK = 9, 1e-8
#: A term's share of the queries times its share of a shard's documents from which on it is
#: a row of the matrix; most such rows; queries that are multiplied at once.
MATRIX_SHARE, MATRIX_TERMS, MATRIX_QUERIES = 0.003, 1024, 256
#: Documents and postings of queries that are added up at once.
STEP = 1 << 19
#: Relative error that sums of ``MATRIX_TERMS`` products of single precision stay far below.
MARGIN = 5e-4
#: Of the threshold, what the terms behind the pivot may add up to.
BEHIND = 0.05
#: Shards searched first: one in so many, and so many at most.
FIRST, MOST_FIRST = 16, 24


def impacts(tf, length, mean_length: float, idf):
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def shards(docs: DataFrame) -> DataFrame:
    """One row per shard: documents, words, a hash, its distinct words, how many documents hold
    each, and, pickled, ids, lengths and the postings by word and document."""
    def shard(held):
        ids, lengths, doc, key, tf = map(np.concatenate, zip(*held, strict=True))
        by_length = np.argsort(lengths, kind="stable")
        place = np.empty_like(by_length)
        place[by_length] = np.arange(len(ids))
        doc = _narrow(place[doc])
        order = np.argsort(doc, kind="stable")
        order = order[np.argsort(key[order], kind="stable")]
        keys, count = np.unique(key, return_counts=True)
        ids = ids[by_length]
        data = pickle.dumps((ids, lengths[by_length], doc[order], _narrow(tf[order])), 5)
        mark = xxhash.xxh64_intdigest(ids.tobytes()) >> 1
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)]), pa.array([int(lengths.sum())]), pa.array([mark], pa.int64()),
             *[pa.array([x], pa.binary()) for x in (keys.tobytes(), count.tobytes(), data)]],
            names=["n", "words", "mark", "keys", "counts", "data"])

    def run(batches):
        held, size, n = [], 0, 0
        for part in slices(batches, limit=min(SLICE_BYTES, SHARD_BYTES)):
            for at in range(0, part.num_rows, SHARD_DOCS):
                batch = part.slice(at, SHARD_DOCS)
                texts = batch.column("text").fill_null("")
                more = texts.nbytes
                if held and (size + more > SHARD_BYTES or n + batch.num_rows > SHARD_DOCS):
                    yield shard(held)
                    held, size, n = [], 0, 0
                starts, codes, values = words_of(texts)
                row = np.repeat(np.arange(n, n + batch.num_rows), np.diff(starts))
                pair, tf = np.unique(row * max(1, len(values)) + codes, return_counts=True)
                held.append((batch.column("doc_id").to_numpy(), np.diff(starts),
                             (pair // max(1, len(values))).astype(np.int32),
                             word_keys(values)[pair % max(1, len(values))], tf.astype(np.int32)))
                size, n = size + more, n + batch.num_rows
        if held:
            yield shard(held)
        del held
        settle()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(
        run, "n long, words long, mark long, keys binary, counts binary, data binary")


class Shard:
    """Inverted index of some documents over a query block's terms that they hold."""

    def __init__(self, ids, lengths, start, doc, tf, idf, asked, mean_length):
        """Postings of term ``i`` are from ``start[i]`` to ``start[i + 1]``; ``asked`` is its share of the queries."""
        self.ids, self.docs, self.terms = ids, len(ids), len(idf)
        n = np.diff(start)
        self.t_start, self.t_doc = start, doc.astype(np.int32)
        term = np.repeat(np.arange(self.terms, dtype=np.int32), n)
        impact = impacts(tf, lengths[doc].astype(float), mean_length, np.repeat(idf, n))
        self.t_impact = impact.astype(np.float32)
        # By document, terms in order.
        by_doc = np.argsort(doc, kind="stable")
        self.d_term, self.d_impact = term[by_doc], impact[by_doc]
        self.d_start = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.docs))])
        self.best = np.maximum.reduceat(impact, start[:-1]) if self.terms else np.zeros(0)
        worth = asked * (n / max(1, self.docs))
        common = np.flatnonzero(worth > MATRIX_SHARE)
        common = common[np.argsort(-worth[common], kind="stable")[:MATRIX_TERMS]]
        self.row = np.full(self.terms, -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.docs), np.float32)
        at = _spread(start, common)
        self.matrix[self.row[term[at]], self.t_doc[at]] = impact[at]
        # Largest impact of each term in each block of documents.
        block = self.t_doc // BLOCK_DOCS
        new = np.ones(len(block), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.b_block = block[first]
        self.b_max = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
        self.b_start = np.searchsorted(first, start)
        self.asked = np.zeros(self.terms, bool)

    def _sums(self, terms, row, rows: int):
        """Impacts of ``terms`` added up by row, which each has in ``row``, and document."""
        at = _spread(self.t_start, terms)
        cell = np.repeat(row * self.docs, self.t_start[terms + 1] - self.t_start[terms])
        cell += self.t_doc[at]
        out = np.bincount(cell, self.t_impact[at], rows * self.docs)
        return out.astype(float, copy=False).reshape(rows, self.docs)  # of nothing, it counts

    def full_scores(self, docs, query):
        """Scores in full, terms added in one order whatever the shard."""
        self.asked[query] = True
        parts = [slice(a, b) for a, b in zip(self.d_start[docs].tolist(),
                                             self.d_start[docs + 1].tolist(), strict=True)]
        kept = [np.flatnonzero(self.asked[self.d_term[p]]) for p in parts]
        self.asked[query] = False
        row = np.repeat(np.arange(len(docs)), [len(x) for x in kept])
        return np.bincount(row, np.concatenate(
            [np.zeros(0), *[self.d_impact[p][x] for p, x in zip(parts, kept, strict=True)]]), len(docs))

    def search(self, terms, start, own, k: int, threshold):
        """For each query that has any: its place and its documents that may be among the best ``k``, with full scores.

        ``terms`` are those of all queries, the rarest of each first, from ``start[i]`` to
        ``start[i + 1]``; -1 are terms that no document holds.
        """
        for a in range(0, len(own), MATRIX_QUERIES):
            b = min(a + MATRIX_QUERIES, len(own))
            part = terms[start[a]:start[b]]
            query = np.repeat(np.arange(b - a), np.diff(start[a:b + 1]))[part >= 0]
            part = part[part >= 0]
            row = self.row[part]
            wanted = np.zeros((b - a, len(self.matrix)), np.float32)
            wanted[query[row >= 0], row[row >= 0]] = 1
            product = wanted @ self.matrix
            rest, whose = part[row < 0], query[row < 0]
            work = np.cumsum(self.docs + np.bincount(
                whose, self.t_start[rest + 1] - self.t_start[rest], b - a))
            c = 0
            while c < b - a:
                e = max(c + 1, int(np.searchsorted(work, (work[c - 1] if c else 0) + STEP, "right")))
                at = slice(*np.searchsorted(whose, [c, e]))
                mine = slice(a + c, a + e)
                for i, docs in self._group(rest[at], whose[at] - c, product[c:e], own[mine], k,
                                           threshold[mine]):
                    yield a + c + i, docs, self.full_scores(docs, part[query == c + i])
                c = e

    def _group(self, rest, whose, product, own, k: int, threshold):
        """The same without the scores, for some queries of which the matrix's terms are added up."""
        count = len(own)
        # Pivot: the terms behind it add up to too little to take the place of those before it.
        best = self.best[rest]
        along = np.cumsum(best)
        total = np.append(0.0, along)[np.searchsorted(whose, np.arange(count), "right")]
        behind = total[whose] - along + best <= BEHIND * threshold[whose]
        left = np.bincount(whose[behind], best[behind], count) * (1 + MARGIN)
        score = self._sums(rest[~behind], whose[~behind], count)
        score += product
        least = (threshold - SLACK) / (1 + MARGIN)
        bound = np.where(least > left, least - left, np.nextafter(0, 1))
        at, docs = np.divmod(np.flatnonzero(score >= bound[:, None]), max(1, self.docs))
        kept = self.ids[docs] != own[at]
        at, docs = at[kept], docs[kept]
        cuts = np.searchsorted(at, np.arange(count + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            found = docs[cuts[i]:cuts[i + 1]]
            if len(found) > k:
                found = self._fewer(found, score[i], rest[(whose == i) & behind], left[i],
                                    least[i], k)
            if len(found):
                yield i, found

    def _fewer(self, found, score, behind, left: float, least: float, k: int):
        """Those of ``found`` that the terms behind the pivot may still bring among the best ``k``."""
        if len(behind):
            at = _spread(self.b_start, behind)
            room = np.bincount(self.b_block[at], self.b_max[at], self.docs // BLOCK_DOCS + 1)
            found = found[score[found] + room[found // BLOCK_DOCS] * (1 + MARGIN) >= least]
            unread = (self.t_start[behind + 1] - self.t_start[behind]).sum()
            if unread < (self.d_start[found + 1] - self.d_start[found]).sum():
                # Many are left: reading the other terms once is cheaper than each document.
                score = score + self._sums(behind, np.zeros(len(behind), np.int64), 1)[0]
                found, left = found[score[found] >= least], 0.0
        if len(found) > k:  # what is added so far is a floor
            kth = np.partition(score[found], -k)[-k] * (1 - 2 * MARGIN) - SLACK
            found = found[score[found] + left >= kth]
        return found


def _spread(start, which):
    """Places of all postings of the terms ``which``."""
    n = start[which + 1] - start[which]
    return np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _best(ids, scores, k: int):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, terms``: sorted distinct hashed words."""
    def step(batch, texts):
        starts, codes, values = words_of(texts)
        keys = word_keys(values).view(np.int64)
        rows = [np.unique(keys[codes[a:b]]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return [batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))]

    return per_text(queries.select("doc_id", "text"), step, "query_id long, terms array<long>")


def _frequencies(table: DataFrame, terms) -> DataFrame:
    """Documents with each of the broadcast terms, one partial count for each task."""
    def run(batches):
        known = terms.value
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("counts"), strict=True):
                at, where = _known(np.frombuffer(keys.as_buffer(), np.uint64), known)
                count[at] += np.frombuffer(n.as_buffer(), np.int64)[where]
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], ["t", "n"])

    return table.select("keys", "counts").mapInArrow(run, "t long, n long").groupBy("t").agg(
        F.sum("n").alias("n"))


def _known(keys, known):
    """Places in ``known`` of the sorted ``keys`` that are there, and the places of these."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    where = np.flatnonzero(known[at] == keys)
    return at[where], where


def _found(table: DataFrame, block, thresholds, mean_length: float, k: int) -> DataFrame:
    """``query, doc_id, score`` of each task's best documents for the queries of a block."""
    def run(batches):
        known, idf, asked, own, start, terms = block.value
        floor = thresholds.value
        top, reached = [(np.zeros(0, np.int64), np.zeros(0))] * len(own), np.zeros(len(own))
        for batch in batches:
            for keys, n, data in zip(*[batch.column(c) for c in ("keys", "counts", "data")],
                                     strict=True):
                at, where = _known(np.frombuffer(keys.as_buffer(), np.uint64), known)
                n = np.frombuffer(n.as_buffer(), np.int64)
                ids, lengths, doc, tf = pickle.loads(data.as_buffer())
                mine = np.zeros(len(n), bool)
                mine[where] = True
                kept = np.repeat(mine, n)
                shard = Shard(ids, lengths, np.concatenate([[0], np.cumsum(n[where])]), doc[kept],
                              tf[kept], idf[at], asked[at], mean_length)
                place = np.full(len(known), -1, np.int32)
                place[at] = np.arange(len(at))
                least = np.maximum(floor, reached)
                for i, docs, new in shard.search(place[terms], start, own, k, least):
                    new = np.round(new, PLACES)
                    good = new >= least[i]
                    ids, scores = top[i]
                    ids, scores = top[i] = _best(np.concatenate([ids, shard.ids[docs[good]]]),
                                                 np.concatenate([scores, new[good]]), k)
                    if len(ids) == k:
                        reached[i] = scores[-1]
                del shard
        settle()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(own, [len(ids) for ids, _ in top])),
            pa.array(np.concatenate([ids for ids, _ in top])),
            pa.array(np.concatenate([s for _, s in top]))], ["query_id", "doc_id", "score"])

    return table.select("keys", "counts", "data").mapInArrow(
        run, "query_id long, doc_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(table: DataFrame, asked: pa.Table, count: int, mean_length: float, k: int,
           first: int) -> DataFrame:
    """Results of some queries; shards with marks up to ``first`` give thresholds to the others."""
    context = table.sparkSession.sparkContext
    asked = asked.sort_by("query_id").combine_chunks()
    own = asked["query_id"].to_numpy()
    lists = asked["terms"].combine_chunks()
    start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    keys = lists.flatten().to_numpy().view(np.uint64)
    known, terms = np.unique(keys, return_inverse=True)
    found = _frequencies(table, context.broadcast(known)).toArrow()
    df = np.zeros(len(known))
    df[found["t"].to_numpy()] = found["n"].to_numpy()
    idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
    terms = terms[np.lexsort((-idf[terms], np.repeat(np.arange(len(own)), np.diff(start))))]
    share = np.bincount(terms, minlength=len(known)) / len(own)
    block = context.broadcast((known, idf, share, own, start, terms.astype(np.int32)))
    floor = np.zeros(len(own))
    early = _ranked(_found(table.where(F.col("mark") <= first), block, context.broadcast(floor),
                           mean_length, k), k).toArrow()
    last = early.filter(pc.equal(early["rank"], k))
    floor = floor.copy()
    floor[np.searchsorted(own, last["query_id"].to_numpy())] = last["score"].to_numpy()
    late = _found(table.where(F.col("mark") > first), block, context.broadcast(floor), mean_length,
                  k)
    return late.unionByName(table.sparkSession.createDataFrame(
        early.select(["query_id", "doc_id", "score"]), late.schema))


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the ``k`` best of ``docs`` for each query's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        "doc_id is not null")
    queries = queries.where("doc_id is not null")
    asked = materialize(query_terms(queries).groupBy("query_id").agg(F.array_distinct(F.flatten(
        F.collect_list("terms"))).alias("terms")).where("size(terms) > 0"), "queries")
    table = materialize(shards(docs), "postings")
    total = table.agg(F.sum("n"), F.sum("words")).head()
    marks = sorted(r.mark for r in table.select("mark").collect())
    first = marks[min(-(-len(marks) // FIRST), MOST_FIRST) - 1] if marks else 0
    blocks = -(-asked.count() // BLOCK_QUERIES)
    out = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    for i in range(blocks if total[1] else 0):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if own.num_rows:
            out = out.unionByName(_block(table, own, total[0], total[1] / total[0], k, first))
    return _ranked(out, k).select("query_id", "rank", "doc_id", "score")
