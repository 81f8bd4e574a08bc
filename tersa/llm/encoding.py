"""Byte-level BPE over slices of texts.

A text is cut at single spaces and line ends between other characters; the
published pattern never joins across them, so each distinct chunk is encoded
once per slice and the ids are gathered with array operations. Texts where that
cut is not safe (runs of white space, the special token) are cut by the pattern
itself.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import Memo

# The published pattern of the vocabulary, its special token, and white space.
SPECIAL = "<|endoftext|>"
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_GAP = r"[\t-\r\x{85}\p{Z}]"
_UNSAFE = rf"{_GAP}{_GAP}|^{_GAP}|{_GAP}$|<\|endoftext\|>"

#: Entries that a worker remembers, twice at most: merged pieces, and chunks merged natively.
_MEMO, _NATIVE_MEMO = 200_000, 60_000


@lru_cache(maxsize=1)
def _pieces():
    return regex.compile(PATTERN)


def default_path(kind: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(kind)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeQueue:
    """Encode by merge ranks: a priority queue over a doubly linked list of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.rank, self.joined = {}, []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.joined.append(vocab[left + right])
        byte = {x: b for b, x in enumerate(letters)}
        self.string = {i: bytes(byte[x] for x in s) for s, i in vocab.items()}
        self.string.update((i, s.encode()) for s, i in self.special.items())
        self.listed = {i: str(i) for i in self.string}
        self.memo = Memo(self._entry, _MEMO)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece. Equal ranks merge from the left; stale entries are skipped.

        A queue entry is a rank and a position. A rank names one pair of symbols,
        so an entry is stale when its position now has another rank.
        """
        first, rank, joined = self.first, self.rank.get, self.joined
        symbols = [first[b] for b in data]
        size = len(symbols)
        here = [rank(a << 32 | b, -1) for a, b in pairwise(symbols)]
        here.append(-1)
        queue = [r << 32 | i for i, r in enumerate(here) if r >= 0]
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while queue:
            entry = heappop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if here[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbols[i], symbols[j], here[j] = (new := joined[r]), -1, -1
            if k < size:
                before[k] = i
                r = here[i] = rank(new << 32 | symbols[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                here[i] = -1
            h = before[i]
            if h >= 0:
                r = here[h] = rank(symbols[h] << 32 | new, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return [x for x in symbols if x >= 0]

    def _entry(self, piece: str):
        ids = [self.special[piece]] if piece in self.special else self.merge(piece.encode())
        listed = self.listed
        return pack(f"<{len(ids)}I", *ids), ",".join([listed[i] for i in ids]), self.decode(ids)

    def encode(self, chunk: str) -> list[int]:
        cut = [chunk] if chunk in self.special else _pieces().findall(chunk)
        return [i for x in cut for i in np.frombuffer(self.memo[x][0], "<u4").tolist()]

    def entries(self, values: list[str]) -> list[tuple[bytes, str, bytes]]:
        """Packed ids, listed ids and decoded bytes of each chunk."""
        memo, cut, special, out = self.memo, _pieces().findall, self.special, []
        for value in values:
            if value.isascii() and value[1:].isalpha() and (value[0] == " " or value[0].isalpha()):
                out.append(memo[value])  # letters, behind one space at most, are one piece
                continue
            pieces = [value] if value in special else cut(value)
            if len(pieces) == 1:
                out.append(memo[pieces[0]])
            else:
                packed, listed, decoded = zip(*[memo[x] for x in pieces], strict=True) \
                    if pieces else ((), (), ())
                out.append((b"".join(packed), ",".join(listed), b"".join(decoded)))
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.string[i] for i in ids])


class Ranked:
    """The same ids from the library that merges in native code; for counts and packing."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {SPECIAL: len(ranks)}
        self.library = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks,
                                         special_tokens=self.special)
        self.line = self.library.encode_ordinary("\n")[0]
        self.memo, self.old = {}, {}

    def encode(self, chunk: str) -> list[int]:
        if chunk in self.special:
            return [self.special[chunk]]
        return self.library.encode_ordinary(chunk)

    def entries(self, values: list[str]) -> list[bytes]:
        """Packed ids of each chunk. What is new is encoded together, a line each."""
        if len(self.memo) > _NATIVE_MEMO:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        lines = []
        for value in values:
            if value not in memo:
                if value in old:
                    memo[value] = old[value]
                elif not value or value in self.special or value[-1].isspace() \
                        or "\n" in value or value[:1].isspace() and (
                            value[0] != " " or value[1:2].isspace()):
                    memo[value] = np.array(self.encode(value), "<u4").tobytes()
                else:
                    lines.append(value)
        if lines:
            ids = np.array(self.library.encode_ordinary("\n".join(lines)), "<u4")
            raw, at = ids.tobytes(), 0
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
            for value, end in zip(lines, ends, strict=True):
                memo[value] = raw[4 * at:4 * end]
                at = end + 1
        return [memo[v] for v in values]


@lru_cache(maxsize=4)
def coder(kind: str, path: str):
    """One per worker, with what it remembers."""
    return {"queue": MergeQueue, "ranked": Ranked}[kind](path)


def _plain_cut(text: str) -> list[str]:
    """Pieces of a text that cannot be cut at spaces; the special token stays whole."""
    out = []
    for n, part in enumerate(text.split(SPECIAL)):
        if n:
            out.append(SPECIAL)
        out += _pieces().findall(part)
    return out


def _strings(values: pa.Array) -> list[str]:
    """Strings without spaces as a list; one long string is quicker to hand over than many."""
    rows = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(rows, " ")[0].as_py().split(" ") if len(values) else []


def chunks(texts: pa.Array):
    """Cut texts (no nulls) into chunks that encode on their own.

    Returns ``(starts, codes, values)`` as ``words_of`` does; joined in order, the
    values of a text give the text.
    """
    unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
    kept = pc.if_else(pa.array(unsafe), pa.scalar("", texts.type), texts) if unsafe.any() else texts
    parts = pc.split_pattern(pc.replace_substring(kept, "\n", " \n "), " ")
    starts = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    values = _strings(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # The first chunk of a text or line has no space before it, and a line end has none.
    opening = np.zeros(len(codes) + 1, bool)
    opening[starts[:-1]] = True
    if "\n" in values:
        lines = np.flatnonzero(codes == values.index("\n"))
        opening[lines] = opening[lines + 1] = True
    opening = np.flatnonzero(opening[:-1])
    bare = pc.take(flat, pa.array(opening)).dictionary_encode()
    codes[opening] = len(values) + bare.indices.to_numpy(zero_copy_only=False)
    values = [" " + v for v in values] + _strings(bare.dictionary)
    if unsafe.any():
        place, own = {}, []
        for i in np.flatnonzero(unsafe):
            cut = _plain_cut(texts[int(i)].as_py())
            own.append(np.array([place.setdefault(x, len(values) + len(place)) for x in cut],
                                np.int64))
        values += list(place)
        rows = np.split(codes, starts[1:-1])
        for i, new in zip(np.flatnonzero(unsafe), own, strict=True):
            rows[i] = new
        codes = np.concatenate(rows)
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return starts, codes, values


def encode(texts: pa.Array, path: str):
    """``(token_starts, ids)`` of texts, through the native merges."""
    starts, codes, values = chunks(texts)
    return gather(starts, codes, coder("ranked", path).entries(values))


def gather(starts, codes, packed: list[bytes]):
    """Ids of each text from the packed ids of its chunks."""
    size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
    flat = np.frombuffer(b"".join(packed), "<u4")
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    n = size[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])]
    return ends[starts], ids
