import collections
import hashlib
import math

import numpy as np
import pytest

from tersa.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], schema)


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain rounds over Python integers."""
    fit = [r for r in rows if r[1] and all(
        x is not None and math.isfinite(x) and abs(x) <= 1e14 for x in r[1])]
    if not fit:
        return []
    sizes = collections.Counter(len(r[1]) for r in fit)
    usual = min(sizes, key=lambda n: (-sizes[n], n))
    fit = sorted((r for r in fit if len(r[1]) == usual),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = []
    for _, v, _ in fit:
        x = [math.floor(4096 * c) for c in v] + [0] * (-usual % parts)
        w = len(x) // parts
        cut.append([x[p * w:(p + 1) * w] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e)
                   for e, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[nearest(c[p], book)[1]].append(c[p])
            new.append([[sum(col) // len(groups[e]) for col in zip(*groups[e], strict=True)]
                        if e in groups else old for e, old in enumerate(book)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for (i, _, label), c in zip(fit, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append([i, "".join(f"{e:02x}" for _, e in found), error, label])
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in out), key=repr)


def told(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def floats(x):
    return [[float(np.float32(v)) for v in row] for row in x]


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    near = floats(np.concatenate([rng.normal(c, 0.02, (40, 16)) for c in rng.normal(0, 1, (7, 16))]))
    rows = [(i * 7 % 280, v, [None, 1, 1, 2][i % 4]) for i, v in enumerate(near)]
    rows += [(5, near[0], 1)] * 90 + [(5, near[3], None), (None, near[4], 3)]  # repeated rows
    rows += [(-1, None, 1), (-2, [None] * 16, 1), (-3, [float("nan")] * 16, 1), (-4, [], 1),
             (-5, [float("inf")] * 16, 2), (-6, [0.5] * 15, 2), (-7, [1e30] * 16, 2),
             (400, [0.0] * 16, None), (401, [-1e-9] * 16, 9)]
    assert told(vector_codes.vector_codes(table(spark, rows).repartition(5))) == brute(rows)


@pytest.mark.parametrize("rows", [
    [(1, [0.25] * 8, 1)],
    [(i, [float(i % 2)] * 8, None) for i in range(40)],          # two values, unused entries
    [(i, [1.0, -2.0, 0.1], 4) for i in range(20)],               # three components, eight parts
    [(i, [i / 3 % 1, i / 7 % 1] * 8, i % 3) for i in range(50)],
    [(3, [0.1] * 8, 1), (3, [0.2] * 8, 1), (2, [0.1] * 9, 1)],   # the lengths' majority
])
def test_small_tables(spark, rows):
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    assert told(vector_codes.vector_codes(table(spark, rows))) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8) * 10.0 ** (i % 5 + 3)], i % 2)
            for i in range(60)]
    rows += [(99, [1e13] * 8, 3), (98, [0.0] * 8, 3), (97, [0.0] * 8, 4)]
    want = [(i, code, *[e if e is not None and e < 1 << 63 else None for e in errors], sha)
            for i, code, *errors, sha in brute(rows)]
    assert any(r[2] is None for r in want) and any(r[3] is not None for r in want)
    assert told(vector_codes.vector_codes(table(spark, rows, schema))) == sorted(want, key=repr)


def test_empty_tables(spark):
    df = table(spark, [(1, [0.5] * 8, 1), (2, None, None)])
    assert told(vector_codes.vector_codes(df.limit(0))) == []
    assert told(vector_codes.vector_codes(df.where("vec_id = 2"))) == []


def test_trees_own_every_point_once():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-900, 900, (700, 4)), np.tile([[5, 5, 5, 5]], (400, 1)),
                             rng.integers(0, 9, (500, 4)) + 5_000])
    tree = vector_codes.build(points)
    assert sorted(tree.order) == list(range(len(points)))
    assert (points[tree.order] == tree.points).all()
    for i in range(len(tree.parent)):
        own = tree.points[tree.start[i]:tree.end[i]].astype(float)
        assert (own.sum(axis=0) == tree.total[i]).all()
        assert (np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)) <= tree.radius[i]).all()
    for book in (points[:16], points[-16:], np.tile([[5, 5, 5, 5]], (3, 1))):
        want = ((points[:, None] - book) ** 2).sum(axis=2)
        code, gap = vector_codes.codes(tree, book)
        assert (code == want.argmin(axis=1)).all() and (gap == want.min(axis=1)).all()
        count, total = vector_codes.gains(tree, book)
        assert (count == np.bincount(code, minlength=len(book))).all()
        assert all((points[code == e].sum(axis=0) == total[e]).all() for e in range(len(book)))
    owned = vector_codes.descend(tree, points[[0, 1, -1]])[0]
    assert (tree.end - tree.start)[owned].sum() > 900  # balls are owned without looking inside


def test_candidates_shrink_from_ball_to_ball():
    points = np.random.default_rng(2).integers(-500, 500, (3_000, 2))
    tree, book = vector_codes.build(points), points[:16]
    left = np.ones((len(tree.parent), 16), bool)
    for i, parent in enumerate(tree.parent):
        above = left[parent] if parent >= 0 else left[i]
        left[i] = vector_codes.candidates(tree.centre[i:i + 1], tree.radius[i:i + 1], book, above[None])
        own = tree.points[tree.start[i]:tree.end[i]].astype(int)
        nearest = ((own[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
        assert left[i][nearest].all() and not (left[i] & ~above).any()
