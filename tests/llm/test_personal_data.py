import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tersa.llm import char_tagger, personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "plain words", "a.b@c.d.e, x@y", "@a.b@c.d x@a.b@c.d", "10.0.0.1.2.3.4.5 1.2.3.256 1.2.3",
    "4111 1111 1111 1111 and 4111-1111 11111112", "+1 (171) 555-2028 +12 +1((((((2", "+44 20 7946 0958.",
    "é" * 5 + "x@y.zz 日本 1.2.3.4", "8" * 100_000, "a" * 100_000, "1." * 40_000, "@" * 20_000,
    "+1(" * 20_000, "a@b.c " * 3_000, "4111 1111 1111 1111 +4111 1111 1111 1111", "00.1.02.003",
    "x@y.z퟿1.2.3.4", "%@-.-", "1" * 4_000 + ".2.3.4",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True,
                "ip": lambda: all(int(x[:5000]) <= 255 for x in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return personal_data.fit(documents)


def test_base_spans_equal_the_patterns():
    for text in TEXTS:
        if text is not None and len(text) < 20_000:
            assert personal_data.base_spans(text) == plain_spans(text), text[:80]
    rng = random.Random(4)
    for _ in range(3_000):
        text = "".join(rng.choice(["1", "4", "25", ".", "@", " ", "-", "+", "a", "é", "(", "_"])
                       for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_query_over_odd_rows(spark, model):
    rows = [(None if i == 4 else i, t, "x") for i, t in enumerate([*TEXTS, *TEXTS[:6]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").coalesce(3)
    out = personal_data.digests(df, model)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = []
    for i, text, _ in rows:
        spans = personal_data.base_spans(text or "")
        told = [f"{k}:{a}:{b}" for a, b, k in spans]
        want.append((i, *[sum(s[2] == k for s in spans) for k in PLAIN],
                     hashlib.sha256(",".join(told).encode()).hexdigest(), told))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:6] == w[:6]
        mine = g[6].split(",") if g[6] else []
        assert [x for x in mine if not x.startswith("lstm_")] == w[6]
    assert personal_data.personal_data(df.limit(0)).count() == 0
    assert personal_data.personal_data(df.where("text = 'plain words'")).count() == 2


def test_values_of_spans(spark, model):
    text = "é mail jörg.müller@exämple.de, call (171) 555-2028, x@y.zz"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = personal_data.personal_spans(df, model).head().spans
    assert {(s.kind, s.value) for s in spans} >= {
        ("lstm_phone", "(171) 555-2028"), ("email", "x@y.zz")}
    assert all(text[s.start:s.end] == s.value for s in spans)


def test_tagger_finds_held_out_spans_and_leaves_clean_texts(documents, model):
    learnt = set(personal_data.sample_texts(documents))
    texts = sorted({r.text for r in documents.collect() if r.text and r.text not in learnt})
    alone, found, asked, added, clean = personal_data.tagged(model, texts), 0, 0, 0, 0
    for text, own in zip(texts, alone, strict=True):
        base = personal_data.base_spans(text)
        asked += len(base)
        found += sum(any(a < e and s < b and k == kind for a, b, k, _ in own) for s, e, kind in base)
        if not base:
            clean += 1
            added += bool(personal_data.added_spans(text, own, base))
    assert asked >= 20 and found >= 0.9 * asked
    assert clean > 5_000 and added <= 0.001 * clean


def test_other_spellings_are_added_whole(model):
    rng, right, asked = np.random.default_rng(9), 0, 0
    for i in range(60):
        phone = f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        text = "the and of ther inhe " * (i % 7) + phone + " ther the and onhe" * 3
        own = personal_data.added_spans(text, personal_data.tagged(model, [text])[0], [])
        asked += 1
        right += [text[a:b] for a, b, _ in own] == [phone]
    assert right >= 0.8 * asked


def test_added_spans_keep_off_base_spans():
    text = "x@y.zz (171) 555-2028 4111.1111.1111.1111"
    found = [(0, 10, "email", 9.0), (7, 21, "phone", 9.0), (22, 41, "card", 1.0), (22, 41, "ip", 9.0)]
    base = personal_data.base_spans(text)
    assert personal_data.added_spans(text, found, base) == [(7, 21, "lstm_phone")]
    assert personal_data.added_spans(text, [(6, 22, "phone", 9.0)], []) == [(7, 21, "lstm_phone")]


# Windows ----------------------------------------------------------------------

def test_windows_hold_every_trigger():
    rng = random.Random(2)
    w, s = personal_data.WINDOW, personal_data.STRIDE
    for n in (0, 1, 95, 96, 97, 143, 144, 145, 500, 997):
        for _ in range(20):
            text = "".join(rng.choice("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 1") for _ in range(n))
            grid = [0] if n else []
            while grid and grid[-1] + w < n:
                grid.append(grid[-1] + s)
            want = [a for a in grid if re.search("[0-9@]", text[a:a + w])]
            assert personal_data.window_starts(text) == want


def test_reconcile_takes_the_best_sum():
    rng = random.Random(8)
    for _ in range(300):
        spans = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 20)
            spans.append((a, a + rng.randint(1, 8), rng.randint(0, 3), rng.randint(1, 50) / 4))
        best = max(sum(s[3] for s in some) for n in range(len(spans) + 1)
                   for some in itertools.combinations(spans, n)
                   if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2)))
        got = personal_data.reconcile(spans)
        assert sum(s[3] for s in got) == best
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(got))


def test_pieces_cut_by_windows_are_joined():
    found = [(0, 80, 96, 1, 5.0), (48, 80, 120, 1, 9.0)]                    # whole in the second
    assert sorted(personal_data.joined(found, 300))[0][:3] == (80, 120, 1)
    found = [(0, 60, 96, 2, 6.0), (48, 60, 144, 2, 12.0), (96, 96, 170, 2, 9.0)]  # longer than any
    assert [s[:3] for s in personal_data.joined(found, 300)] == [(60, 170, 2)]
    found = [(0, 90, 96, 2, 6.0), (96, 96, 99, 3, 2.0)]                     # other kinds stay apart
    assert sorted(s[:3] for s in personal_data.joined(found, 300)) == [(90, 96, 2), (96, 99, 3)]


# The network ------------------------------------------------------------------

def small_problem():
    rng = np.random.default_rng(0)
    ids = rng.integers(97, 101, (3, 6)).astype(np.uint8)
    ids[2, 4:] = char_tagger.PAD
    tags = np.array([[0, 1, 2, 0, 3, 4], [1, 2, 2, 0, 0, 0], [0, 3, 4, 4, 0, 0]])
    return ids, tags


def test_gradients_equal_differences():
    ids, tags = small_problem()
    model = char_tagger.Tagger(2, hidden=3, dtype=np.float64)
    _, grads = model.gradients(ids, tags)
    rng = np.random.default_rng(1)
    for name, value in model.params.items():
        seen = [(w, i, j) for w in range(2) for i in (97, 99, 131) for j in (0, 5, 11)] \
            if name == "wx" else [tuple(rng.integers(0, n) for n in value.shape) for _ in range(8)]
        for at in seen:
            old, ends = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = old + d
                ends.append(model.gradients(ids, tags)[0])
            value[at] = old
            assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6), (name, at)


def test_chain_equals_all_sequences():
    rng = np.random.default_rng(6)
    model = char_tagger.Tagger(2, hidden=3, dtype=np.float64)
    model.params["moves"] = rng.normal(0, 1, (5, 5))
    e, tags = rng.normal(0, 2, (4, 5, 5)), np.array([[0, 1, 2, 0, 0]] * 4)
    moves, first = model.chain()

    def score(row, path):
        return first[path[0]] + sum(e[row, t, k] for t, k in enumerate(path)) + sum(
            moves[a, b] for a, b in itertools.pairwise(path))

    best = model.viterbi(e)
    loss = char_tagger.chain_gradients(e, moves, first, tags)[0]
    want = 0.0
    for row in range(4):
        paths = list(itertools.product(range(5), repeat=5))
        scores = np.array([score(row, p) for p in paths])
        assert tuple(best[row]) == paths[int(scores.argmax())]
        top = scores.max()
        want += top + np.log(np.exp(scores - top).sum()) - score(row, tags[row])
    assert loss == pytest.approx(want)


def test_symbols_are_one_a_code_point():
    text = "aZ9é 日\U0001f600١"
    assert personal_data.symbols(text).tolist() == [
        97, 65, 48, char_tagger.LETTER, char_tagger.SPACE, char_tagger.LETTER, char_tagger.OTHER, 48]
