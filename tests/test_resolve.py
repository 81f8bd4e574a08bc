import random
from difflib import SequenceMatcher

import pytest

from tersa.operators import resolve, skew
from tersa.operators.components import connected_components

FIELDS = {c: c for c in ("tax_id", "iban", "email", "phone", "name", "company", "postal_code")}
DDL = "row_id long, tax_id string, iban string, email string, phone string, name string, " \
      "company string, postal_code string"


def table(spark, records):
    return spark.createDataFrame(
        [(i, *(r.get(c) for c in FIELDS)) for i, r in enumerate(records)], DDL)


def groups(spark, records, **kw):
    found = resolve.find_duplicates(table(spark, records), FIELDS, **kw)
    out = {}
    for r in found.members.collect():
        out.setdefault(r.group_id, set()).add(r.row_id)
    return sorted(sorted(g) for g in out.values()), found


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def brute(records, threshold=0.92):
    """All pairs, in row order; the definition rather than the method."""
    weight = {"tax_id": 1.0, "iban": 0.98, "email": 0.97, "phone": 0.90}
    evidence, edges = {}, []

    def link(i, j, kind, value, conf):
        edges.append((i, j))
        if (i, j) not in evidence or evidence[i, j][2] < conf:
            evidence[i, j] = (kind, value, conf)

    def usable(v):
        return (v or "").strip().lower() not in resolve.fixed.NULL_TOKENS

    for kind, conf in weight.items():
        seen = {}
        for i, r in enumerate(records):
            if usable(r.get(kind)):
                key = r[kind].strip().lower()
                if key in seen:
                    link(seen[key], i, kind, key, conf)
                seen[key] = i
    blocks = {}
    for i, r in enumerate(records):
        blocks.setdefault((r.get("postal_code") or "")[:5] or "_", []).append((i, r["key"]))
    for rows in blocks.values():
        rows = [x for x in rows if x[1]]
        for p, (i, a) in enumerate(rows):
            for j, b in rows[p + 1:]:
                if abs(len(a) - len(b)) / max(len(a), len(b), 1) > 0.2:
                    continue
                score = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
                if score >= threshold:
                    link(i, j, "name", a, score * 0.9)
    label = union_find(edges)
    best = {}
    for (i, j), (kind, value, conf) in sorted(evidence.items()):
        g = label[i]
        if g not in best or conf > best[g][2]:
            best[g] = (kind, value, conf)
    return label, best


def test_small_sets(spark):
    a, g = groups(spark, [
        {"tax_id": "12345678Z", "name": "Iker Zabala"}, {"tax_id": "12345678Z", "name": "I. Zabala"},
        {"tax_id": "00000000T"}])
    row = g.groups.head()
    assert a == [[0, 1]] and (row.confidence, row.survivor_row) == (1.0, 0)
    assert groups(spark, [
        {"email": "a@x.com", "phone": "+34600000001"}, {"email": "a@x.com", "phone": "+34600000002"},
        {"email": "c@x.com", "phone": "+34600000002"},
        {"company": "Talleres Gómez S.L.", "postal_code": "28001"},
        {"company": "TALLERES GOMEZ SOCIEDAD LIMITADA", "postal_code": "28001"},
        {"company": "Talleres Gómez S.L.", "postal_code": "08001"},
        {"company": "Construcciones Norte SL", "postal_code": "28002"},
        {"company": "Construcciones Sur SL", "postal_code": "28002"},
        {"company": "Panaderia Central SL", "postal_code": "28002"},
        {"email": None}, {"email": ""}, {"email": "nan"}, {"email": " N/A "}, {"email": "null"},
    ])[0] == [[0, 1, 2], [3, 4]]


def random_records(seed, n):
    rng = random.Random(seed)
    stems = ["talleres gomez", "talleres gomes", "construcciones gonzalez norte",
             "construcciones gonzales norte", "distribuciones martinez e hijos sur",
             "aaaaaaaaaaaaaaaaaaaaaaaa", "ab", "muñoz y peña asociados"]
    out = []
    for _ in range(n):
        s = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(s))
            op = rng.random()
            if op < 0.4:
                s[p] = rng.choice("abcdefgñ z")
            elif op < 0.7:
                del s[p]
            else:
                s.insert(p, rng.choice("abcxyz"))
            s = s or ["x"]
        r = {"name": "".join(s), "postal_code": rng.choice(["28001", "28001", "08001", None])}
        if rng.random() < 0.1:
            r["phone"] = str(600000000 + rng.randrange(20))
        if rng.random() < 0.1:
            r["tax_id"] = f"T{rng.randrange(15)}"
        out.append(r)
    return out


@pytest.mark.parametrize("seed,threshold,floor", [
    (1, 0.92, 1_000_000), (2, 0.88, 5), (3, 0.75, 1_000_000), (4, 0.92, 5)])
def test_against_all_pairs(spark, seed, threshold, floor):
    records = random_records(seed, 160)
    df = table(spark, records)
    for r in resolve.with_name_key(df, FIELDS).selectExpr("row_id", "__key").collect():
        records[r.row_id]["key"] = r["__key"]
    found = resolve.find_duplicates(df, FIELDS, threshold=threshold, floor=floor)
    label, best = brute(records, threshold)
    got = {r.row_id: r.group_id for r in found.members.collect()}
    assert got == label
    evidence = {r.group_id: (r.key_type, r.key_value, r.confidence) for r in found.groups.collect()}
    assert evidence.keys() == best.keys()
    for g, (kind, value, conf) in best.items():
        assert evidence[g][:2] == (kind, value) and evidence[g][2] == pytest.approx(conf)


def test_one_key_holds_a_third(spark):
    records = [{"phone": "600000000"} if i % 3 == 0 else {"phone": f"7{i:08d}"} for i in range(300)]
    records[50]["email"] = records[61]["email"] = "x@y.es"
    found = resolve.find_duplicates(table(spark, records), FIELDS, floor=10)
    sizes = sorted(r["size"] for r in found.groups.collect())
    assert sizes == [2, 100]
    assert resolve.duplicate_findings(found, floor=10).count() == 100
    nested = resolve.nested_groups(found, part_rows=50, floor=10).collect()
    big = [r for r in nested if r["size"] == 100]
    assert len(big) == 6 and sum(len(r.duplicate_rows) for r in big) == 99
    whole = [r for r in resolve.nested_groups(found).collect() if r["size"] == 100]
    assert len(whole) == 1 and whole[0].duplicate_rows == list(range(3, 300, 3))


@pytest.mark.parametrize("floor", [1_000_000, 3])
def test_components(spark, floor):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(60)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges += [(5000 + i, 4999) for i in range(20)] + [(7, 7)]
    got = {r.row_id: r.group_id for r in connected_components(
        spark.createDataFrame(edges, "a long, b long"), floor).collect()}
    want = union_find(edges)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "a long, b long"), floor, max_rounds=1)


def test_attach_bounds_what_it_broadcasts(spark):
    assert skew.heavy_limit(10**12) == 10**9
    assert skew.heavy_limit(5) == skew.MIN_HEAVY_ROWS
    rows = spark.range(90).selectExpr("id", "IF(id % 3 = 0, -1, id) AS k")
    sizes = rows.groupBy("k").count()
    for floor in (5, 1_000_000):
        out = skew.attach(rows, sizes, ["k"], "count", floor)
        assert sorted((r.id, r["count"]) for r in out.collect()) == [
            (i, 30 if i % 3 == 0 else 1) for i in range(90)]


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        resolve.find_duplicates(table(spark, [{}]), FIELDS, threshold=0)


def test_crowded_blocks_give_the_same_pairs(spark, sf_dir, monkeypatch):
    """Pairs of grams, as in blocks of many keys, and single grams find the same names."""
    from tersa.plans import queries

    few = {tuple(r) for r in queries.candidate_pairs(spark, sf_dir).collect()}
    monkeypatch.setattr(resolve, "_FEW_KEYS", 0)
    assert {tuple(r) for r in queries.candidate_pairs(spark, sf_dir).collect()} == few
    assert few


@pytest.mark.parametrize("floor", [1_000_000, 4])
def test_rows_get_the_size_of_their_group(spark, floor):
    keys = ["hot"] * 40 + ["a", "a", "b", None, ""]
    rows = resolve.materialize(spark.createDataFrame(
        [(i, k) for i, k in enumerate(keys)], "i long, k string"), "rows")
    got = {r.i: r.n for r in skew.counted(rows, ["k"], "n", floor).collect()}
    assert got == {i: keys.count(k) for i, k in enumerate(keys) if k is not None}
    assert skew.counted(rows.where("i < 0"), ["k"], "n", floor).count() == 0
