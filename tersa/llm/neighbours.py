"""Approximate nearest neighbours (operator 10).

Multi-index hashing: vectors get binary codes from learned rotations (principal
axes, then the rotation that loses least when signs are taken), codes are split
into substrings and each substring is indexed. By the pigeonhole principle a
code within Hamming radius r agrees with the query up to r // m bits in one of
the m substrings, so probing the substrings retrieves every code within the
radius; those are ranked by the exact cosine of the original vectors.

The index is built per shard of rows; blocks of queries meet each shard and the
best of each pair of shard and block are merged. The rotations and the radius
come from a bounded sample of ``SAMPLE`` rows; every row is indexed.

Rows take no part if the id or the vector is null, the vector is zero, holds null
or non-finite components or has another dimension than most rows (ties: the smaller).
Every row is a query or candidate of its own, whatever its id: rows alike in id and
vector travel as one with their number, and a query leaves out one such row, its own.
Equal scores go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import bounded

#: Rows that the rotations and the radius are fitted on, and queries among them.
SAMPLE, SAMPLE_QUERIES = 8_000, 200
#: Share of the sample's true neighbours that lie within the radius.
WITHIN = 0.98
CODE_BITS, PART_BITS = 128, 16
SHARD_ROWS, BLOCK_QUERIES = 4_096, 2_048
ROUNDS = 25


def usable(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` (doubles) of the rows that take part."""
    v = f"transform({vector}, x -> cast(x as double))"
    return df.selectExpr(f"cast({id_column} as bigint) AS id", f"{v} AS v").where(
        "id is not null and v is not null and exists(v, x -> x <> 0) and forall(v, x -> "
        "x is not null and not isnan(x) and abs(x) < double('infinity'))")


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; large components are scaled first so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosine of each row with ``q``; equal rows get equal values."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    x, q = x / scale, q / np.abs(q).max()
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def learn(sample: np.ndarray, k: int, bits: int = CODE_BITS, seed: int = 7):
    """Centre, projections to ``bits`` signs, and the radius that holds ``WITHIN``."""
    u = unit(sample)
    rng, d = np.random.default_rng(seed), u.shape[1]
    centre = u.mean(axis=0)
    axes = np.linalg.eigh(np.cov((u - centre).T).reshape(d, d) if len(u) > 1 else np.eye(d))[1]
    v, parts = (u - centre) @ axes, []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        parts.append(axes @ turn)
    project = np.hstack(parts)[:, :bits]
    codes = encode(u, centre, project)
    rows = rng.permutation(len(u))[:SAMPLE_QUERIES]
    distances = []
    for i in rows:
        near = u @ u[i]
        near[i] = -2
        best = np.argsort(-near)[:min(k, len(u) - 1)]
        distances.append(np.bitwise_count(codes[best] ^ codes[i]).sum(axis=1))
    distances = np.concatenate(distances) if distances else np.zeros(1)
    radius = int(np.quantile(distances, WITHIN)) if len(distances) else bits
    return centre, project, radius


def encode(u: np.ndarray, centre: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Codes as substrings of 16 bits, one row per vector."""
    signs = np.packbits((u - centre) @ project >= 0, axis=1)
    if signs.shape[1] % 2:
        signs = np.pad(signs, ((0, 0), (0, 1)))
    return np.ascontiguousarray(signs).view(np.uint16)


@lru_cache(maxsize=PART_BITS + 1)
def ball(radius: int) -> np.ndarray:
    """Differences of at most ``radius`` bits in a substring."""
    every = np.arange(1 << PART_BITS, dtype=np.uint32).astype(np.uint16)
    return every[np.bitwise_count(every) <= radius]


class MultiIndex:
    """Substring tables over codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for part in codes.T:
            order = np.argsort(part, kind="stable")
            values, begin = np.unique(part[order], return_index=True)
            self.tables.append((order, values, np.append(begin, len(part))))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Positions of every code within ``radius``, ascending."""
        hit, limit = np.zeros(len(self.codes), bool), radius // len(self.tables)
        for (order, values, begin), part in zip(self.tables, query, strict=True):
            if limit < PART_BITS and len(ball(min(limit, PART_BITS))) < len(values):
                probes = part ^ ball(limit)
                at = np.searchsorted(values, probes)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probes)]
            else:  # fewer keys than probes: look at the keys
                at = np.flatnonzero(np.bitwise_count(values ^ part) <= limit)
            n = begin[at + 1] - begin[at]
            hit[order[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ query).sum(axis=1) <= radius]


def _search(base, queries, model, k):
    """Best ``k`` rows of a shard for each query: ``(query's place, vec_id, score)``.

    Both sides are ``(ids, vectors, how many rows)``.
    """
    (ids, vectors, rows), (query_ids, asked, _) = base, queries
    centre, project, radius = model
    index, bits = MultiIndex(encode(unit(vectors), centre, project)), project.shape[1]
    wanted = encode(unit(asked), centre, project)
    out = []
    for place, (query_id, q, code) in enumerate(zip(query_ids, asked, wanted, strict=True)):
        own = np.flatnonzero(ids == query_id)
        own = own[(vectors[own] == q).all(axis=1)]
        reach = radius
        while True:  # a shard without enough codes in reach is probed further out
            found = index.within(code, reach)
            left = rows[found] - np.isin(found, own)
            if left.sum() >= k or reach >= bits:
                break
            reach = min(bits, reach + 8)
        found, left = found[left > 0], left[left > 0]
        score = cosines(vectors[found], q) if len(found) else np.empty(0)
        best = np.lexsort((ids[found], -score))[:k]
        best = np.repeat(best, np.minimum(left[best], k))[:k]
        out += [(place, i, s) for i, s in zip(ids[found][best], score[best], strict=True)]
    return out


def _matrix(column, dimension: int):
    """Rows of the right dimension as a matrix, and which they are."""
    right = pc.equal(pc.list_value_length(column), dimension).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimension), right


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows of ``df`` to each query.

    Both sides are ``id, v`` as ``usable`` gives them.
    """
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows, asked = df.count(), queries.count()
    if not rows or not asked:
        return spark.createDataFrame([], schema)
    row = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    dimension = row.n
    picked = bounded(df.where(F.size("v") == dimension), ["id", "v"], sample, row["count"])
    model = learn(np.array([r.v for r in picked.collect()], np.float64), k)
    shards, blocks = -(-rows // SHARD_ROWS), max(1, -(-asked // BLOCK_QUERIES))
    base, probes = (d.groupBy("id", "v").agg(F.count("*").alias("n")) for d in (df, queries))
    base = base.withColumn("shard", F.expr(f"pmod(xxhash64(id, v), {shards}L)")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("q", F.lit(False))
    probes = probes.withColumn(
        "block", F.expr(f"cast(pmod(xxhash64(id, v, 1), {blocks}L) as int)")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    ).withColumn("q", F.lit(True)).select(base.columns)

    def cell(table: pa.Table) -> pa.Table:
        sides = []
        for q in (False, True):
            part = table.filter(pc.equal(table["q"], q)).combine_chunks()
            v, right = _matrix(part["v"].combine_chunks() if part.num_rows else
                               pa.array([], pa.list_(pa.float64())), dimension)
            sides.append((part["id"].to_numpy()[right], v, part["n"].to_numpy()[right]))
        found = _search(*sides, model, k) if all(len(ids) for ids, _, _ in sides) else []
        place, ids, scores = zip(*found, strict=True) if found else ([], [], [])
        asked = sides[1]
        return pa.table({"query_id": pa.array(asked[0][list(place)], pa.int64()),
                         "copies": pa.array(asked[2][list(place)], pa.int64()),
                         "q": pa.array([asked[1][i].tobytes() for i in place], pa.binary()),
                         "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(scores, pa.float64())})

    best = base.unionByName(probes).groupBy("shard", "block").applyInArrow(
        cell, "query_id long, copies long, q binary, vec_id long, score double")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "query_id", "rank", "vec_id", "score")
