import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tersa.llm import bpe, encoding, packing, token_counts

ODD = [None, "", " ", "a  b", "x <|endoftext|> y<|endoftext|>", "\n \n b", " lead", "trail ",
       "don't  've  x", "é́ñ 12½ ²", "\x1c a\x1fb \x85 c", "😀 👍🏽 x", "a \tb", "'s 't",
       "日本語 テキスト", "line\nnext\n\nend\n", "x" * 3000, "word " * 2000, "\r\n", "it's IT'S"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def docs(spark, texts, extra="ids"):
    rows = [(i if i % 5 else None if i == 5 else i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra} string").coalesce(2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_same_ids_as_the_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    column = pa.array(texts, pa.string())
    for kind, path in (("queue", encoding.default_path()),
                       ("ranked", encoding.default_path("byte_bpe_50k.tiktoken"))):
        starts, codes, values = encoding.chunks(column)
        made = encoding.coder(kind, path).entries(values)
        at, ids = encoding.gather(starts, codes, [m[0] if kind == "queue" else m for m in made])
        for i, text in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == lib.encode(text, add_special_tokens=False).ids
            assert "".join(values[c] for c in codes[starts[i]:starts[i + 1]]) == text


def test_round_trip_and_digests(spark, library):
    df = docs(spark, ODD + ODD[:3])
    want = {}
    for i, t in enumerate(ODD + ODD[:3]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i if i != 5 else None, (ids, library.decode(ids, skip_special_tokens=False)))
    whole = {r.doc_id: (r.ids, r.decoded) for r in bpe.bpe_texts(df).collect()}
    assert whole == want
    for r in bpe.bpe_digests(df).collect():
        ids, text = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_digests(df.where("doc_id < 0")).count() == 0


def test_merge_queue_breaks_ties_from_the_left(library):
    queue = encoding.MergeQueue(encoding.default_path())
    for piece in ("aaaaaaa", "thththth", "ababababab", "zzzzzzzzzzzzzzzz", "abc"):
        assert queue.encode(piece) == library.encode(piece, add_special_tokens=False).ids


def test_token_counts(spark, library):
    df = docs(spark, ODD)
    n = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD)
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(df)), block=7)
    for r in sums.collect():
        assert r.docs == n.count(r.n_tokens)
        assert r.docs_from == sum(x >= r.n_tokens for x in n)
        assert r.tokens_from == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert (r.total_tokens, r.total_docs) == (sum(n), len(n))
        assert r.share_upto == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    for limit in (0, 1, 5, 100, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.length_quantile(sums, 0.5) == n[(len(n) - 1) // 2]
    assert token_counts.token_counts(df.where("doc_id < 0")).count() == 0


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
    histogram = {x: lengths.count(x) for x in set(lengths)}
    room, where = {}, {}
    for length, low, high, per, first, base in packing.plan(histogram, capacity):
        for r in range(low, high):
            b, at = first + (r - low) // per, base + (r - low) % per * length
            assert (length, r) not in where and at == capacity - room.get(b, capacity)
            where[length, r], room[b] = b, room.get(b, capacity) - length
    assert len(where) == len(lengths) and min(room.values()) >= 0
    assert sorted(room.values()) == one_by_one(lengths, capacity)


def test_packing(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    texts = ODD + ["a b c"] * 9 + ["word " * 5000, "x y " * 1023]
    rows = packing.best_fit(docs(spark, texts, "length")).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        at = 0
        for offset, length in held:
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    whole = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        whole[i if i != 5 else None] = ids
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == whole.keys()
    for doc, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        ids, at = whole[doc], 0
        assert len(pieces) == max(1, -(-len(ids) // packing.CAPACITY))
        for n, r in enumerate(pieces):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == packing.CAPACITY)
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    assert len(places) == len(one_by_one([r.length for r in rows], packing.CAPACITY))
    assert packing.best_fit(docs(spark, texts).where("doc_id < 0")).count() == 0
    same = docs(spark, ["a b"]).union(docs(spark, ["a b"])).union(docs(spark, ["a b"]))
    assert len({(r.sequence_id, r.offset) for r in packing.best_fit(same).collect()}) == 3
