"""Vector code compression (operator 11).

Integer vectors are cut into equal parts, and each part position gets a codebook by
Lloyd rounds: every part goes to its nearest entry, every entry becomes the floored
mean of its parts. The rounds are exact but look at few points: each shard of rows
has a metric tree per part, built once by the anchors hierarchy. Anchors are chosen
one after the other, each the point farthest from its anchor, and take the points
that are nearer to them; these balls are the middle. They are merged upwards, two
balls of the smallest common ball first, and split downwards by anchors of their own.
A ball keeps the sum and count of its points. In a round, a ball inherits the
entries that are candidates for its parent and drops those that are farther from
all its points than another; once one entry is left, the ball is wholly owned and
its sum and count are added as they are. Points are only compared in leaves that are
still contested.

One pass over the table writes the shards (rows and trees) to the shared folder. A
round reads it, adds up what balls and leaves give each entry, and aggregates by
part, entry and place; 8 x 16 entries reach the driver. Nothing is shuffled by row.
Sums over equal labels are partial sums, brought back by ``operators.skew.attach``.

Rows are dropped if the vector is null or empty, holds null or non-finite components,
has another length than most vectors (ties: the shorter), or a component beyond
``MOST`` (its distances would fit no long). Vectors whose length is no multiple of
the parts are filled up with zeros. First entries: the parts of the smallest ids,
null ids last; rows of one id by components, each counting, so repeated rows may
give equal entries, of which the first wins all ties. Fewer rows than entries give
fewer entries. Distances equal in full precision go to the lower entry. An error
beyond a long is null, and so is the sum over its label. Null labels are equal.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components with greater amounts are taken for non-finite.
MOST = 1e14
#: Bytes of integer components in a shard, and points of a ball that is not split.
SHARD_BYTES, LEAF = 4 << 20, 32
#: Integers up to this amount have squared distances of any usual part in 64 bits.
SMALL = 1 << 27


def usable(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
           label: str = "label") -> DataFrame:
    """``id, v, label`` of the rows with finite components; the vector in doubles."""
    v = f"transform({vector}, x -> cast(x as double))"
    return df.selectExpr(f"{id_column} AS id", f"{v} AS v", f"{label} AS label").where(
        "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) "
        f"and abs(x) <= {MOST!r}D)")


def usual_length(df: DataFrame) -> int | None:
    """The commonest length of ``v``; the shorter one of those equally common."""
    row = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return row.n if row else None


def to_integers(v: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * v)``, filled up with zeros to a multiple of ``parts``, as ``(part, row, place)``."""
    x = np.floor(v * float(scale)).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def packed(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of points to entries, exact: Python integers where 64 bits are too few."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if top * top * 4 * points.shape[1] < 1 << 52:  # products and sums are whole in doubles
        x, c = points.astype(float), entries.astype(float)
        d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)
        return d.astype(np.int64)
    kind = np.int64 if top <= SMALL and points.shape[1] <= 64 else object
    x, c = points.astype(kind), entries.astype(kind)
    return ((x[:, None, :] - c) ** 2).sum(axis=2)


@dataclass
class Tree:
    """Balls of one part of a shard, parents before their children.

    ``order`` lists the points so that each ball is a stretch of it.
    """

    points: np.ndarray  # in tree order
    order: np.ndarray
    parent: np.ndarray
    level: np.ndarray  # where each level's balls begin
    start: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray


class _Ball:
    __slots__ = ("centre", "children", "members", "radius")

    def __init__(self, points: np.ndarray, members: np.ndarray, children=()):
        own = points[members]
        self.members, self.children = members, children
        self.centre = own.mean(axis=0)
        self.radius = math.sqrt(((own - self.centre) ** 2).sum(axis=1).max()) * (1 + 1e-9)


def anchors(points: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """Members by their nearest anchor, about the square root of their number of anchors.

    A new anchor is the point farthest from its own. Points within half the distance
    of their anchor and the new one stay where they are, so nothing is computed for them.
    """
    x = points[members]
    owner, near, places = np.zeros(len(x), np.int64), ((x - x[0]) ** 2).sum(axis=1), [0]
    for k in range(1, math.isqrt(len(x) - 1) + 1):
        new = int(near.argmax())
        if near[new] == 0:
            break
        gaps = ((x[places] - x[new]) ** 2).sum(axis=1)
        mine = np.flatnonzero(4 * near >= gaps[owner])
        d = ((x[mine] - x[new]) ** 2).sum(axis=1)
        closer = d < near[mine]
        taken = mine[closer]
        near[taken], owner[taken] = d[closer], k
        places.append(new)
    by = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(places)))
    return [g for g in np.split(members[by], ends[:-1]) if len(g)]


def _middle_out(points: np.ndarray, members: np.ndarray) -> _Ball:
    """A ball of ``members``: anchors' balls merged upwards and split downwards."""
    whole = _Ball(points, members)
    if len(members) <= LEAF or whole.radius == 0:
        return whole
    groups = anchors(points, members)
    if len(groups) < 2:
        return whole
    balls = [_middle_out(points, g) for g in groups]
    n = len(balls)
    alive = np.ones(n, bool)
    centre, radius = np.array([b.centre for b in balls]), np.array([b.radius for b in balls])
    span = np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2)) + radius[:, None] + radius
    np.fill_diagonal(span, np.inf)
    for left in range(n, 1, -1):
        i, j = divmod(int(span.argmin()), n)
        if left == 2:
            whole.children = (balls[i], balls[j])
            return whole
        balls[i] = _Ball(points, np.concatenate([balls[i].members, balls[j].members]),
                         (balls[i], balls[j]))
        centre[i], radius[i] = balls[i].centre, balls[i].radius
        alive[j] = False
        span[j], span[:, j] = np.inf, np.inf
        own = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1)) + radius + radius[i]
        own[~alive] = np.inf
        own[i] = np.inf
        span[i], span[:, i] = own, own
    return whole


def build(points: np.ndarray) -> Tree:
    """The tree of one part of a shard."""
    level, levels = [(_middle_out(points.astype(float), np.arange(len(points))), -1, 0)], []
    balls, parents, starts, leaves = [], [], [], []
    while level:
        levels.append(len(balls))
        below = []
        for ball, parent, start in level:
            for child in ball.children:
                below.append((child, len(balls), start))
                start += len(child.members)
            parents.append(parent)
            starts.append(start - sum(len(c.members) for c in ball.children))
            leaves.append(not ball.children)
            balls.append(ball)
        level = below
    start = np.array(starts)
    end = start + [len(b.members) for b in balls]
    order = np.empty(len(points), np.int64)
    for ball, a, leaf in zip(balls, starts, leaves, strict=True):
        if leaf:
            order[a:a + len(ball.members)] = ball.members
    ordered = points[order]
    exact = object if int(np.abs(points).max(initial=0)) * len(points) >= 1 << 62 else np.int64
    along = np.concatenate([np.zeros((1, points.shape[1]), exact),
                            np.cumsum(ordered.astype(exact), axis=0)])
    return Tree(packed(ordered), order.astype(np.int32), np.array(parents),
                np.array([*levels, len(balls)]), start, end, np.array(leaves),
                np.array([b.centre for b in balls]), np.array([b.radius for b in balls]),
                along[end] - along[start])


def candidates(centre: np.ndarray, radius: np.ndarray, entries: np.ndarray,
               inherited: np.ndarray) -> np.ndarray:
    """Which inherited entries may be nearest to some point of each ball.

    An entry goes if all points lie on the side of the ball's best entry, by a margin
    above what doubles may round; equal entries went before. Integers beyond ``SMALL``
    are left to the exact comparison.
    """
    if max(np.abs(centre).max(initial=0), np.abs(entries).max(initial=0)) > SMALL:
        return np.broadcast_to(inherited, (len(centre), len(entries))).copy()
    c = entries.astype(float)
    d = ((centre[:, None, :] - c) ** 2).sum(axis=2)
    best = np.where(inherited, d, np.inf).argmin(axis=1)
    least = d[np.arange(len(d)), best][:, None]
    apart = np.sqrt(((c[:, None] - c) ** 2).sum(axis=2))[best]
    return inherited & ~(d - least > 2 * radius[:, None] * apart + 1e-6 * (d + least) + 1e-3)


def descend(tree: Tree, entries: np.ndarray):
    """``(ball, entry)`` of the wholly owned balls, and the contested leaves' points with theirs."""
    first = np.ones(len(entries), bool)  # of equal entries, the later ones never win
    for i in range(1, len(entries)):
        first[i] = not (entries[:i] == entries[i]).all(axis=1).any()
    lists = np.zeros((len(tree.parent), len(entries)), bool)
    owned, owner, contested = [], [], []
    above = np.array([-1])
    for a, b in zip(tree.level[:-1].tolist(), tree.level[1:].tolist(), strict=True):
        here = a + np.flatnonzero(np.isin(tree.parent[a:b], above))
        if not len(here):
            break
        inherited = lists[tree.parent[here]] if a else first[None, :]
        left = candidates(tree.centre[here], tree.radius[here], entries, inherited)
        lists[here] = left
        alone = left.sum(axis=1) == 1
        owned.append(here[alone])
        owner.append(left[alone].argmax(axis=1))
        contested.append(here[~alone & tree.leaf[here]])
        above = here[~alone & ~tree.leaf[here]]
    owned, owner, contested = map(np.concatenate, (owned, owner, contested))
    n = tree.end[contested] - tree.start[contested]
    at = np.repeat(tree.start[contested] - np.cumsum(n) + n, n) + np.arange(n.sum())
    d = distances(tree.points[at], entries)
    # A dropped entry is farther than a kept one, so the lists need not be asked again.
    return owned, owner, at, (d.argmin(axis=1) if len(at) else np.empty(0, np.int64))


def gains(tree: Tree, entries: np.ndarray):
    """Counts and sums of the points nearest to each entry."""
    owned, owner, at, entry = descend(tree, entries)
    count = np.bincount(entry, minlength=len(entries))
    np.add.at(count, owner, (tree.end - tree.start)[owned])
    total = np.zeros(entries.shape, tree.total.dtype)
    np.add.at(total, owner, tree.total[owned])
    np.add.at(total, entry, tree.points[at].astype(tree.total.dtype))
    return count, total


def codes(tree: Tree, entries: np.ndarray):
    """Entry and squared distance of every point, in the shard's order of rows."""
    owned, owner, at, entry = descend(tree, entries)
    n = tree.end[owned] - tree.start[owned]
    code = np.zeros(len(tree.order), np.int64)
    code[np.repeat(tree.start[owned] - np.cumsum(n) + n, n) + np.arange(n.sum())] = \
        np.repeat(owner, n)
    code[at] = entry
    top = max(int(np.abs(tree.points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int64 if top <= SMALL and entries.shape[1] <= 64 else object
    gap = tree.points.astype(kind) - entries.astype(kind)[code]
    out_code, out_gap = np.empty_like(code), np.empty(len(code), kind)
    out_code[tree.order], out_gap[tree.order] = code, (gap * gap).sum(axis=1)
    return out_code, out_gap


def shards(df: DataFrame, length: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """One row per shard: ids, labels and, pickled, a tree of each part."""
    schema = df.schema
    most = max(1, SHARD_BYTES // (8 * length))

    def shard(batches):
        rows = pa.concat_tables([pa.Table.from_batches([b]) for b in batches]).combine_chunks()
        v = rows["v"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        trees = [build(x) for x in to_integers(v, parts, scale)]
        kept = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), rows[c].chunk(0))
                for c in ("id", "label")]
        data = pa.array([pickle.dumps(trees, 5)], pa.binary())
        return pa.RecordBatch.from_arrays([*kept, data], names=["id", "label", "trees"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            right = pc.equal(pc.list_value_length(batch.column("v")), length)
            batch = batch.filter(right)
            while batch.num_rows:
                held.append(batch.slice(0, most - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == most:
                    yield shard(held)
                    held, n = [], 0
        if held:
            yield shard(held)

    kinds = {c: schema[c].dataType.simpleString() for c in ("id", "label")}
    return df.mapInArrow(
        run, f"id array<{kinds['id']}>, label array<{kinds['label']}>, trees binary")


def first_entries(df: DataFrame, length: int, parts: int, entries: int, scale: int) -> list:
    """The parts of the smallest ids."""
    rows = df.where(F.size("v") == length).orderBy(F.col("id").asc_nulls_last(), "v").select(
        "v").limit(entries).collect()
    return list(to_integers(np.array([r.v for r in rows], float), parts, scale))


def lloyd_round(table: DataFrame, books: list) -> list:
    """Codebooks after one more assignment of every part."""
    def run(batches):
        total = None
        for batch in batches:
            for data in batch.column("trees"):
                new = [gains(t, b) for t, b in zip(pickle.loads(data.as_py()), books, strict=True)]
                total = new if total is None else [
                    (n + m, s.astype(object) + t) for (n, s), (m, t) in zip(total, new, strict=True)]
        if total is None:
            return
        rows = [(p, e, i, int(n[e]), int(s[e, i])) for p, (n, s) in enumerate(total)
                for e in np.flatnonzero(n).tolist() for i in range(s.shape[1])]
        columns = [*zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, k) for c, k in zip(columns[:4], (
                pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
             pa.array(list(map(str, columns[4])))], names=["p", "e", "i", "n", "s"])

    parts = table.select("trees").mapInArrow(run, "p int, e int, i int, n long, s string")
    new = [b.astype(object) for b in books]
    for r in parts.groupBy("p", "e", "i").agg(
            F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new[r.p][r.e, r.i] = int(r.s) // r.n
    return [b.astype(np.int64) for b in new]


def encode(table: DataFrame, books: list) -> DataFrame:
    """``id, label, code, error`` of every row; two hex digits of the code a part."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = [codes(t, b) for t, b in zip(
                    pickle.loads(batch.column("trees")[row].as_py()), books, strict=True)]
                code = np.ascontiguousarray(np.array([c for c, _ in found], np.uint8).T)
                error = sum(e.astype(object) for _, e in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, 1).flatten() for c in ("id", "label")]
                    + [pa.array([c.tobytes().hex() for c in code]),
                       pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                    names=["id", "label", "code", "error"])

    kinds = {c: table.schema[c].dataType.elementType.simpleString() for c in ("id", "label")}
    return table.mapInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def digest(books: list) -> str:
    """Of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()
                          ).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame | None, list]:
    """``id, label, code, error`` of ``vectors`` (as ``usable`` gives them), and the codebooks.

    At most 256 entries, so that an index has two hex digits.
    """
    length = usual_length(vectors)
    if length is None:
        return None, []
    books = first_entries(vectors, length, parts, entries, scale)
    table = materialize(shards(vectors, length, parts, scale), "shards")
    for _ in range(rounds):
        books = lloyd_round(table, books)
    return encode(table, books), books


def vector_codes(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that is kept."""
    vectors = usable(df, id_column, vector, label)
    coded, books = compress(vectors)
    if coded is None:
        return vectors.select(
            F.col("id").alias(id_column), F.lit("").alias("code"),
            *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")],
            F.lit("").alias("codebooks_sha256")).limit(0)
    rows = materialize(coded.withColumn("key", F.struct(
        F.col("label").isNull().alias("none"),
        F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))), "codes")
    sums = materialize(rows.groupBy("key").agg(
        F.count("*").alias("size"), F.when(F.count("*") == F.count("error"), F.try_sum("error"))
        .alias("label_error")), "label_errors")
    return attach(rows, sums, ["key"], "size").select(
        F.col("id").alias(id_column), "code", "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"))
