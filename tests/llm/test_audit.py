import collections
import itertools
import re

from tersa.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    None, "", " \t\n", "few words", LONG, LONG, LONG + " &", LONG.upper(), "same " * 150, "ABC " * 120,
    "few words", LONG, LONG.upper() + " #", "é" * 300, "x\x0by\x0cz\rw\x1cv", "  a  b",
    " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)),
    "A" + "a" * 9, "AA" + "a" * 17, "w " * 100_000, "few words",
]


def brute(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    seen = collections.defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and smallest[t] < i:
            fails.add("E")
        seen[lang or ""].append((fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part, rows in seen.items():
        share = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                failing = sum(x in r[0] for r in rows)
                left = [r for r in left if x not in r[0]]
                share[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(r[0] == {x} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def told(df):
    assert df.schema.simpleString() == "struct<" + ",".join(
        ":".join(f.split()).replace("long", "bigint") for f in filter_audit.SCHEMA.split(",")) + ">"
    rows = df.collect()
    out = {tuple(r[:3]): list(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def frames(spark, docs, labels):
    # names of working columns as columns of the input
    d = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in docs],
                              "doc_id long, text string, lang string, mask int, part string, n int, t int")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_equals_filtering_in_every_order(spark):
    docs = [(None if i in (9, 10) else i if i != 21 else 3, t, [None, "", "en", "de"][i * 7 % 4])
            for i, t in enumerate(TEXTS)]
    docs += [docs[5], (5, LONG, "fr"), (-7, "ABC " * 120, "en")]
    labels = [(0, 1, 0), (4, 1, None), (4, 0, 1), (5, None, 1), (11, 1, 1), (11, 1, 1), (None, 1, 1),
              (999, 1, 1), (7, 0, 0)]
    d, m = frames(spark, docs, labels)
    got = told(filter_audit.filter_audit(d.repartition(3), m))
    assert got == brute(docs, labels)
    assert len(got) == 600 * 4


def test_audit_of_whole_tables(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = told(filter_audit.filter_audit(d, m))
    want = brute([tuple(r) for r in d.select("doc_id", "text", "lang").collect()],
                 [tuple(r) for r in m.select("doc_id", "quality", "toxic").collect()])
    assert got == want


def test_audit_of_empty_tables(spark):
    d, m = frames(spark, [(1, "a", "en")], [(1, 1, 1)])
    assert told(filter_audit.filter_audit(d.limit(0), m)) == {}
    alone = told(filter_audit.filter_audit(d, m.limit(0)))
    assert alone == brute([(1, "a", "en")], [])


def test_intervals_cover_each_order_once():
    orders, seen = filter_audit.orders(), set()
    assert [filter_audit.lehmer_rank(o) for o in orders] == list(range(120))
    for mask, step, low, high in filter_audit.intervals():
        for rank in range(low, high):
            bits = [mask >> "ABCDE".index(x) & 1 for x in orders[rank]]
            assert bits.index(1) + 1 == step and (mask, rank) not in seen
            seen.add((mask, rank))
    assert len(seen) == 31 * 120
