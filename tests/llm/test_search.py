import numpy as np
import pytest
from pyspark.sql import functions as F

from tersa.llm import topk_search


def test_texts_are_read_once_for_all_blocks(spark, monkeypatch):
    """Before, each block of queries read and split all texts twice."""
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 3)
    rows = [(i, f"w{i % 7} w{i % 5} v{i % 3} common") for i in range(60)]
    queries = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id % 4 = 0")
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(
        run, "doc_id long, text string")
    got = topk_search.search(docs, queries, k=4)
    assert got.groupBy("query_id").agg(F.count("*").alias("n")).where("n = 4").count() == 15
    assert read.value == 60


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_thresholds_of_the_first_shards_lose_nothing(spark, monkeypatch, first):
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 300)
    monkeypatch.setattr(topk_search, "FIRST", first)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(1, 30)) % 90))
            for i in range(120)]
    rows += rows[::9]  # rows alike in id and text
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = topk_search.search(df, df.where("doc_id % 10 = 0"), k=5).collect()
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 1 << 20)
    whole = topk_search.search(df.coalesce(1), df.where("doc_id % 10 = 0"), k=5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(got) == 60


@pytest.mark.parametrize("share", [-1.0, 0.02, 2.0])
@pytest.mark.parametrize("behind", [0.0, 0.3, 0.95])
def test_no_document_is_lost_by_matrix_pivot_or_blocks(monkeypatch, share, behind):
    monkeypatch.setattr(topk_search, "MATRIX_SHARE", share)
    monkeypatch.setattr(topk_search, "BEHIND", behind)
    monkeypatch.setattr(topk_search, "BLOCK_DOCS", 8)
    monkeypatch.setattr(topk_search, "MATRIX_QUERIES", 16)
    monkeypatch.setattr(topk_search, "STEP", 2000)
    rng = np.random.default_rng(3)
    docs, terms, k = 300, 80, 5
    held = rng.random((terms, docs)) < rng.random((terms, 1)) ** 3
    held[np.arange(terms), rng.integers(0, docs, terms)] = True
    tf = np.where(held, rng.integers(1, 6, held.shape), 0)
    lengths, idf = np.maximum(tf.sum(axis=0), 1), rng.random(terms) * 8 + 0.1
    term, doc = np.nonzero(tf)
    start = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    ids = rng.permutation(docs // 2).repeat(2)  # each id twice
    lists = [np.flatnonzero(rng.random(terms) < p) for p in rng.random(50) * 0.5]
    lists = [x[np.argsort(-idf[x], kind="stable")] for x in lists]
    asked = np.bincount(np.concatenate(lists), minlength=terms) / 50
    shard = topk_search.Shard(ids, lengths, start, doc.astype(np.uint16), tf[term, doc].astype(
        np.uint8), idf, asked, lengths.mean())
    value = np.where(held, topk_search.impacts(tf, lengths, lengths.mean(), idf[:, None]), 0)
    own = np.where(np.arange(50) % 2, np.arange(50), -1)
    full = np.array([value[x].sum(axis=0) for x in lists])
    full[ids == own[:, None]] = 0
    kth = np.sort(full, axis=1)[:, -k]
    # Absent terms are -1.
    lists = [np.concatenate([[-1], x]) for x in lists]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    for threshold in (np.zeros(50), kth, kth * 0.7):
        got = {i: dict(zip(d.tolist(), s, strict=True)) for i, d, s in shard.search(
            np.concatenate(lists), starts, own, k, threshold)}
        for i in range(50):
            best = np.flatnonzero((full[i] > 0) & (full[i] >= kth[i]))
            assert set(best.tolist()) <= set(got.get(i, {}))
            assert np.allclose(list(got.get(i, {}).values()), full[i][list(got.get(i, {}))])
            assert not set(np.flatnonzero(ids == own[i]).tolist()) & set(got.get(i, {}))
