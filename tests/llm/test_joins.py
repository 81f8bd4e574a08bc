import random
import re
from functools import partial

import numpy as np
import pytest

from tersa.llm import neighbours, ngram_join, topk_search
from tersa.operators.skew import attach


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def near_texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(
        rng.choice([3, 30, 60, 200]))) for _ in range(n // 8)]
    out = [None, "", "?!", "one", "One!", "one two three four five", "ONE two, three four five."]
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        out.append(" ".join(w))
    rng.shuffle(out)
    return out


def joined(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return links, [low.get(find(i)) for i in range(len(texts))], [find(i) for i in range(len(texts))]


def docs(spark, texts, ids):
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, h int").repartition(3)


@pytest.mark.parametrize("seed,block", [(1, 128), (2, 4)])
def test_join_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    texts = near_texts(seed, 220)
    ids = [i if i % 37 else None for i in range(len(texts))]
    texts.append(texts[5])
    ids.append(5)  # a repeated row
    links, classes, roots = joined(texts, ids)
    df = docs(spark, texts, ids)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_join(df).collect()),
                 key=str)
    assert got == sorted(zip(ids, classes, links, strict=True), key=str)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    left = kept.collect()
    worded = {r for r, t in zip(roots, texts, strict=True) if words(t)}
    assert len(left) == len(worded) + sum(not words(t) for t in texts)
    by_text = dict(zip(texts, roots, strict=True))
    assert len({by_text[r.text] for r in left if words(r.text)}) == len(worded)


@pytest.mark.parametrize("broadcast,floor", [(10**6, 10**6), (0, 5)])
def test_join_of_a_large_group(spark, monkeypatch, broadcast, floor):
    """Also where bands, labels and copies above ``floor`` rows are hot."""
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(ngram_join, "attach", partial(attach, floor=floor))
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = ["same words in every one of these rows"] * 60
    for _ in range(90):
        w = base[:]
        w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    links, classes, _ = joined(texts, list(range(len(texts))))
    df = docs(spark, texts, list(range(len(texts))))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(df).collect()}
    assert got == {i: (classes[i], links[i]) for i in range(len(texts))}
    assert ngram_join.one_of_each(df).count() == 2


def test_join_of_nothing(spark):
    none = docs(spark, ["a"], [1]).where("doc_id > 1")
    assert ngram_join.jaccard_join(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    blank = docs(spark, [None, "", "!"], [None, 1, 2])
    assert sorted(map(tuple, ngram_join.jaccard_join(blank).collect()), key=str) == [
        (1, 1, 0), (2, 2, 0), (None, None, 0)]
    assert ngram_join.one_of_each(blank).count() == 3
    again = docs(spark, ["a b c d e f"] * 3, [None] * 3)
    assert ngram_join.one_of_each(again).count() == 1


def test_pruning_bounds():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert least == sorted(least) and len(least) == ngram_join.HASHES // ngram_join.STEP
    rng = np.random.default_rng(0)
    for n, need in zip(range(16, 97, 16), least, strict=True):  # pairs at 0.8 outlive every step
        assert (rng.binomial(n, 0.8, 20_000) >= need).mean() > 0.999


# --- search -------------------------------------------------------------------

def scores(texts, ids, query):
    import math
    from collections import Counter

    tf = [Counter(words(t)) for t in texts]
    n, mean = len(texts), sum(sum(c.values()) for c in tf) / len(texts)
    df = Counter(w for c in tf for w in c)
    out = []
    for i, c in zip(ids, tf, strict=True):
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                for w in set(words(texts[ids.index(query)])) if c[w])
        if i != query and s > 0:
            out.append((-round(s, 9), i))
    return [i for _, i in sorted(out)]


@pytest.mark.parametrize("shard,block", [(16 << 20, 4000), (700, 3)])
def test_search_against_every_score(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk_search, "BLOCK_DOCS", 4)
    rng = random.Random(9)
    vocabulary = [f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 10, 40])))
             for _ in range(150)]
    texts[7] = texts[8] = texts[20]
    ids = list(range(150))
    df = docs(spark, texts + ["t1 t2"], [*ids, None])
    asked = [i for i in ids if i % 10 == 0]
    got = {}
    for r in topk_search.search(df, df.where("doc_id % 10 = 0"), k=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    for q in asked:
        want = scores(texts, ids, q)[:6]
        assert [d for _, d in sorted(got.get(q, []))] == want
    assert topk_search.search(df, df.where("doc_id < 0")).count() == 0
    assert topk_search.search(df.where("doc_id < 0"), df.where("doc_id = 1")).count() == 0


def test_query_rows_of_one_id_are_one_query(spark):
    rows = [(0, "alpha beta"), (0, "gamma"), *[(i, f"{'alpha' if i % 2 else 'gamma'} w{i}")
                                               for i in range(1, 9)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = topk_search.search(df, df.where("doc_id = 0"), k=10).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 9))
    assert sorted(r.doc_id for r in got) == list(range(1, 9))


def test_small_batches_come_together():
    import pyarrow as pa

    from tersa.llm.common import gathered

    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 30], "n": [1, 2, 3]})
    out = list(gathered([batch, batch, batch], limit=90))
    assert [b.num_rows for b in out] == [6, 3]
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([batch] * 3))
    assert [b.num_rows for b in gathered([batch, batch.slice(0, 0)], limit=15)] == [2, 1]


# --- neighbours ---------------------------------------------------------------

def test_index_finds_every_code():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[250:] = codes[:250] ^ (1 << rng.integers(0, 16, (250, 4))).astype(np.uint16)
    index = neighbours.MultiIndex(codes)
    for radius in (0, 1, 3, 4, 9, 20, 31, 64):
        for q in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 128)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1000)] + 0.3 * rng.normal(size=(1000, 16))).astype(np.float32)
    x[10:60] = x[10]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    odd = [(2000, None, "s"), (2050, [0.0] * 16, "s"), (2100, [float("nan")] * 16, "s"),
           (None, x[0].tolist(), "s"), (2150, [1.0] * 4, "s"), (2200, [float("inf")] * 16, "s")]
    usable = neighbours.usable(vectors(spark, rows + odd))
    got = {}
    for r in neighbours.nearest(usable, usable.where("id % 50 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1000, 50))
    d, hits = x.astype(float), 0
    for q, found in got.items():
        s = (d @ d[q]) / np.linalg.norm(d, axis=1) / np.linalg.norm(d[q])
        s[q] = -9
        best = np.lexsort((np.arange(1000), -np.round(s, 12)))[:5]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - v) < 1e-12 for _, i, v in found)
        hits += len({i for _, i, _ in found} & set(best.tolist()))
    assert hits >= 0.95 * 5 * len(got)
    assert [i for _, i, _ in got[50]] == [10, 11, 12, 13, 14]
    small = neighbours.usable(vectors(spark, rows[:4]))
    assert neighbours.nearest(small, small.where("id = 0")).count() == 3
    assert neighbours.nearest(small.where("id < 0"), small.where("id < 0")).count() == 0
    one = small.where("id = 0")
    assert neighbours.nearest(one, one).count() == 0


def exact_nearest(rows, k):
    """``(query_id, rank, vec_id, score)`` over every other row."""
    out = []
    for n, (i, v) in enumerate(rows):
        if i % 50 == 0:
            q = np.array(v)
            near = sorted((-round(float(q @ w / np.linalg.norm(q) / np.linalg.norm(w)), 9), j)
                          for m, (j, w) in enumerate(rows) if m != n for w in [np.array(w)])
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def test_every_row_is_a_candidate(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8)).astype(np.float32).tolist()
    rows = [(i, x[i]) for i in range(60)]
    rows += [(7, x[0]), (7, x[0]), (0, x[0]), (0, x[3]), (50, x[9])] + [(9, x[20])] * 8
    want = exact_nearest(rows, 5)
    odd = [(-50, [1.0, 2.0]), (-100, [3.0])]  # of another dimension, first by id
    usable = neighbours.usable(vectors(spark, [(*r, "s") for r in odd + rows]))
    got = neighbours.nearest(usable, usable.where("id % 50 = 0"), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == want
    one = neighbours.usable(vectors(spark, [(0, x[0], "s")] * 3))
    assert neighbours.nearest(one, one).count() == 6
