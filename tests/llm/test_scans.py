import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tersa.llm import license_scan, sampling, secret_scan
from tersa.llm.common import Memo

KEY = "AKIA" + "ABCD1234EFGH5678"
HEX = "0123456789abcdef" * 2
TEXTS = [
    None, "", "plain words only", f'token = "{HEX}" and {KEY}.', "password=abcdefgh1", "Password: x1",
    f"{KEY[:19]} AKIAKIA{KEY}", "api_key='secret=zzzzzz'", f"x{HEX}y{HEX[:23]}", "ſecret=abcdefgh",
    "é" * 5 + " passwd :  \"Abc/+=_.-9\"", f"{HEX * 3000}", "token=" + "a" * 5, "İ token=abcdef 日本",
]


def docs(spark, texts):
    rows = [(None if i == 4 else i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").coalesce(2)


def plain_spans(text):
    found = []
    rules = (
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|"""
                   r"""[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
                   r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", "(AKIA[A-Z0-9]+)"), ("hex", "([0-9a-f]+)"))
    for order, (kind, rule) in enumerate(rules):
        for m in re.finditer(rule, text):
            if len(m.group(1)) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_base_spans():
    for t in TEXTS:
        assert secret_scan.base_spans(t or "") == plain_spans(t or "")


@pytest.fixture(scope="module")
def field():
    words = "some ordinary words stand here, 4041894974608795 42.144.35.254 and more of them".split()
    rng = np.random.default_rng(3)

    def value(n):
        return "".join(rng.choice(list("0123456789abcdef"), n))

    texts = []
    for i in range(80):
        own = [f'token = "{value(40)}"', f"password={value(18)}",
               "AKIA" + "".join(rng.choice(list("ABCDEFGH2345"), 16)), ""][i % 4]
        texts.append(" ".join([*rng.permutation(words), own, *rng.permutation(words)]))
    return secret_scan.fit_field(texts)


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 0, 3, 6]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    emission = rng.normal(size=(starts[-1], 3)) * 2
    tags = field.decode(emission, starts)
    for a, b in itertools.pairwise(starts):
        if a == b:
            continue

        def score(path):
            total = field.first[path[0]] + emission[a, path[0]]
            for t in range(1, b - a):
                total += field.moves[path[t - 1], path[t]] + emission[a + t, path[t]]
            return total

        best = max(itertools.product(range(3), repeat=b - a), key=score)
        assert score(tuple(tags[a:b])) == pytest.approx(score(best))


def test_words_alike_share_their_sum(field):
    for token in ["word", "Word,", "(WORD)", "longerwordhere.", "author", "it's", "x=y", "42", "",
                  "Ümläut", "token", "éa" * 9, "---"]:
        assert np.allclose(field.table(token), field._table(token)), token


def test_the_field_adds_what_looks_alike(spark, field):
    missed = "the passcode token -> " + "9f86d081884c7d659a2feaa0" [:22] + " words follow"
    clean = "some ordinary words stand here, 4041894974608795 42.144.35.254 and more of them"
    texts = pa.array([missed, clean, ""], pa.string())
    tags, starts = field.tag_slice(texts, Memo(field.table, 100))
    assert (tags[starts[1]:starts[2]] == secret_scan.OUTSIDE).all()
    base = [(5, 9, "hex")]
    got = secret_scan.added_spans("ab cdefgh ij", np.array([0, 0, 0], np.int8), base)
    assert got == [(0, 2, "crf"), (10, 12, "crf")]
    assert secret_scan.added_spans("x", np.array([2], np.int8), []) == []


def test_secret_digests(spark, field):
    for f in (field, None):
        rows = secret_scan.digests(docs(spark, TEXTS + TEXTS[:2]), f).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            t = TEXTS[4 if r.doc_id is None else r.doc_id % len(TEXTS)] or ""
            base = plain_spans(t)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(
                sum(k == x for _, _, k in base) for x in ("assign", "access", "hex"))
            told = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
            assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
            assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
    spans = secret_scan.secret_spans(docs(spark, TEXTS), None).where("doc_id = 3").head().spans
    assert [s.kind for s in spans] == ["assign", "hex", "access"]


def test_secrets_of_tables(spark, sf_dir):
    out = secret_scan.secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert out.count() == 200
    empty = docs(spark, TEXTS).where("doc_id < 0")
    assert secret_scan.secret_scan(empty).count() == 0
    assert secret_scan.secret_scan(docs(spark, [None, "", "no secrets"])).where(
        "spans <> ''").count() == 0


def test_masking(spark):
    df = docs(spark, TEXTS).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    out = {r.doc_id: r for r in secret_scan.mask_secrets(df).collect()}
    assert out[0].text is None and out[0].n_chars is None and out[2].text == TEXTS[2]
    for r in out.values():
        assert r.spans == "x"
        if r.text is not None:
            assert not plain_spans(r.text) and r.n_chars == len(r.text)
    assert out[3].text == '[assign]" and [access].'


# --- licences ---------------------------------------------------------------

LICENSE_TEXTS = [
    None, "", "All rights reserved. ALL RIGHTS, RESERVED", "CC BY cc-by CC  by-nc 4.0",
    "all rights all rights reserved", "GNU General Public License v3", "acc by x", "ccby",
    "ÀLL rights reserved é all\x00rights~reserved", "İcc by", "cc by " * 5000,
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nx",
    "SPDX-License-Identifier: MIT and", "SPDX-License-Identifier:", "spdx license identifier: )(",
]


def test_base_phrases(spark):
    rows = license_scan.digest(license_scan.license_scan(docs(spark, LICENSE_TEXTS))).collect()
    assert len(rows) == len(LICENSE_TEXTS)
    for r in rows:
        t = LICENSE_TEXTS[4 if r.doc_id is None else r.doc_id] or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            want = phrase.split()
            for i in range(len(words)):
                if words[i:i + len(want)] == want:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (
            (min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan.license_scan(docs(spark, [""]).where("doc_id < 0")).count() == 0


def test_expressions():
    def verdict(text, accepted=("mit", "apache-2.0")):
        tokens = text.replace("(", " ( ").replace(")", " ) ").lower().split()
        postfix = license_scan.to_postfix(tokens)
        return None if postfix is None else license_scan.evaluate(postfix, accepted)

    assert verdict("MIT") is True and verdict("GPL-3.0") is False
    assert verdict("MIT OR GPL-3.0 AND GPL-2.0") is True
    assert verdict("(MIT OR GPL-3.0) AND GPL-2.0") is False
    assert verdict("GPL-2.0 WITH x OR Apache-2.0+") is True
    assert verdict("MIT WITH x AND GPL-2.0") is False
    for bad in ("", "MIT AND", "OR MIT", "(MIT", "MIT)", "MIT GPL", "()", "MIT ( GPL )"):
        assert verdict(bad) is None
    found = license_scan.scan_text(LICENSE_TEXTS[11])
    assert found["expressions"] == [
        "mit gpl-2.0-only classpath-exception-2.0 with or apache-2.0 and=true"]
    assert license_scan.scan_text(LICENSE_TEXTS[12])["expressions"] == ["mit=true"]
    assert license_scan.scan_text(LICENSE_TEXTS[13])["expressions"] == []


def test_long_licence_texts_take_linear_time():
    import time

    for phrase in ("cc by ", "general public license cc by all rights reserved "):
        start = time.perf_counter()
        found = license_scan.scan_text(phrase * (3_000_000 // len(phrase)))
        assert time.perf_counter() - start < 30
        words = phrase.split()
        starts = [i for i in range(len(words)) if words[i] in ("cc", "general", "all")]
        assert found["places"][:2 * len(starts)] == [
            r * len(words) + i for r in range(2) for i in starts]
        assert len(found["places"]) == len(starts) * (3_000_000 // len(phrase))


# --- samples --------------------------------------------------------------------

def test_smallest_hashes_of_each_group(spark, monkeypatch):
    texts = [f"text {i}" for i in range(3_000)] + ["hot copy"] * 2_000 + [
        f"rare {i}" for i in range(7)] + ["none 1", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    group = F.when(F.col("text").startswith("rare"), "r").when(
        ~F.col("text").startswith("none"), "t")
    hashed = {r.text: r.h for r in df.dropna().distinct().select(
        "text", F.xxhash64("text").alias("h")).collect()}
    for spread in (1, 8, 10**6):
        got = sampling.smallest(df, group, {"r": len(texts), "t": len(texts)}, 20, spread)
        rows = [(r.side, r.text) for r in got.collect()]
        usual = sorted((t for t in hashed if t[:4] not in ("rare", "none")), key=hashed.get)[:20]
        assert sorted(rows) == sorted([("t", t) for t in usual] + [
            ("r", f"rare {i}") for i in range(7)])
    assert sampling.smallest(df, group, {}, 20) is None
    assert sampling.smallest(df.limit(0), group, {"t": 0}, 20).count() == 0


def test_the_field_learns_from_different_texts(spark):
    """A large group of copies is one text of the sample."""
    copies = [(i, "nothing to see here") for i in range(2_000)]
    some = [(5_000 + i, f"line {i}\npassword = Xy{i:04d}zZ9q{i * 7919 % 10007:05d}\n") for i in range(40)]
    df = spark.createDataFrame(copies + some, "doc_id long, text string")
    assert secret_scan.fit(df, 300) is not None
    assert secret_scan.fit(df.limit(0)) is None
