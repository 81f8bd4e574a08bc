"""Secret scans (operator 4).

Three base patterns mark secrets by form; a linear-chain conditional random
field adds the ones that look or stand alike. It tags tokens (runs without white
space) as secret begin, inside or outside from their shape, the neighbouring
words and features of the file, and is decoded by Viterbi over the whole text.
Base spans stay as they are; an added span keeps off every base span.

The field is fitted on windows of a bounded sample: ``SAMPLE`` texts where a base
pattern may match and as many others, all different, none longer than
``SAMPLE_CHARS``; the base spans are its labels. Without any base span in the sample nothing is added.

A null text counts as empty: no spans. Offsets are code points. Repeated rows
come out repeated; other columns are not read. One pass without a shuffle, after
the sample (texts whose hash passes, usually in one look over the table).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, per_text, slices, small_batches
from .sampling import smallest

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "api")
MAYBE = "(?i)password|passwd|secret|token|api_?key|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

SAMPLE, SAMPLE_CHARS, AROUND, WINDOW = 300, 20_000, 12, 25
#: Texts among which one where a base pattern may match is looked for at first.
MAYBE_ONE_IN = 32
BEGIN, INSIDE, OUTSIDE = range(3)
#: Bytes of text whose tokens are tagged at once: a token takes some twenty times its bytes.
SLICE = 1 << 20

_TOKEN = re.compile(r"[^\t\n\f\r ]+")
_IS_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * LEAST["hex"]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)``, by start, then by kind as listed.

    Cheap tests that hold for every text with a match go before the patterns.
    """
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST["access"]]
    if _HEX_RUN in text.encode().translate(_IS_HEX):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)
                if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Features -----------------------------------------------------------------

_KEY = re.compile(r"(pass|pwd|secret|token|api_?key|auth|bearer|credential|private|access)", re.I)
_PAIR = re.compile(r"^[\"'({\[]*[A-Za-z_.-]+[\"']?[:=]+")
_EDGE = "\"'`,;()[]{}<>"
_EDGE_END = _EDGE + "."


def value_of(token: str) -> tuple[int, int]:
    """Where the value lies within a token: behind a key, without quotes and stops."""
    m = _PAIR.match(token)
    start, end = (m.end() if m and m.end() < len(token) else 0), len(token)
    while start < end and token[start] in _EDGE:
        start += 1
    while end > start and token[end - 1] in _EDGE_END:
        end -= 1
    return start, end


def shape(token: str) -> str:
    """Classes of characters, and how often they change, in a few letters."""
    start, end = value_of(token)
    value = token[start:end]
    if value.isalpha():
        kind = "l" if value.islower() else "U" if value.isupper() else \
            "C" if value[1:].islower() else "m"
    elif value.isdigit():
        kind = "9"
    else:
        kind = "".join(sorted({
            "l" if c.islower() else "U" if c.isupper() else "9" if c.isdigit() else
            "-" if c in "-_+/=." else "?" for c in value}))
        if all(c in "0123456789abcdefABCDEF" for c in value):
            kind += "h"
    return f"{kind}{min(len(value), 40) // 6}"


def token_features(token: str) -> tuple[list[str], list[str]]:
    """Features of a token for its own tag, and for the tags of its neighbours."""
    s, key = shape(token), bool(_KEY.search(token))
    pair = bool(_PAIR.match(token))
    near = [f"shape={s[:-1]}", f"key={key}", f"pair={pair}"]
    if not any(c.isalnum() for c in token):
        near.append(f"mark={token[:3]}")
    own = ["one", f"shape={s}", f"key={key}", f"pair={pair}", f"key={key},shape={s}"]
    start, end = value_of(token)
    if end - start >= 8:
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(
            token[start:end], token[start + 1:end], strict=False))
        own += [f"mix={min(changes, 12) // 2}", f"head={token[start:start + 4]}",
                f"digits={sum(c.isdigit() for c in token) * 4 // len(token)}"]
    return own, near


def file_features(text: str) -> list[str]:
    """Features of the whole text: size, assignments, digits."""
    n = max(len(text), 1)
    return [f"size={min(n.bit_length(), 20) // 2}", f"equals={'=' in text}",
            f"lines={min(text.count(chr(10)) * 200 // n, 3)}"]


class Field:
    """Weights of a linear-chain conditional random field over three tags."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first
        self.heads = {n[len("own:head="):] for n in weights if n.startswith("own:head=")}
        self.plain: dict = {}

    def _sum(self, place: str, features) -> np.ndarray:
        out = np.zeros(3)
        for f in features:
            w = self.weights.get(place + f)
            if w is not None:
                out += w
        return out

    def table(self, token: str) -> np.ndarray:
        """What a token adds to its own tag, to the next token's and to the last one's.

        The features of a plain word are told by its case, its length and, if the
        field knows it, its head, so words alike in these share one sum.
        """
        word = token.lstrip(_EDGE).rstrip(_EDGE_END)
        if word.isalpha() and not _KEY.search(token):
            size, head = len(word), word[:4]
            kind = (word.islower(), word.isupper(), word[1:].islower(),
                    size if size < 8 else 8 + min(size, 40) // 6,
                    head if size >= 8 and head in self.heads else None)
            found = self.plain.get(kind)
            if found is None:
                found = self.plain[kind] = self._table(token)
            return found
        return self._table(token)

    def _table(self, token: str) -> np.ndarray:
        own, near = token_features(token)
        return np.concatenate([self._sum("own:", own), self._sum("left:", near),
                               self._sum("right:", near)])

    def file(self, text: str) -> np.ndarray:
        return self._sum("file:", file_features(text))

    def decode(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Viterbi over all sequences of a slice at once, one position after the other."""
        size = np.diff(starts)
        order = np.argsort(-size, kind="stable")
        begin, longest = starts[:-1][order], size[order]
        active = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(size) else 0) + 1),
                                 "right")
        back = np.zeros((len(emission), 3), np.int8)
        final = np.zeros((len(size), 3))
        for t, k in enumerate(active.tolist()):
            at = begin[:k] + t
            if t == 0:
                final[:k] = self.first + emission[at]
                continue
            step = final[:k, :, None] + self.moves
            back[at] = step.argmax(axis=1)
            final[:k] = step.max(axis=1) + emission[at]
        tags = np.full(len(emission), OUTSIDE, np.int8)
        tag = final.argmax(axis=1).astype(np.int8)
        for t in range(len(active) - 1, -1, -1):
            at = begin[:active[t]] + t
            tags[at] = tag[:active[t]]
            if t:
                tag[:active[t]] = back[at, tag[:active[t]]]
        return tags

    def tag_slice(self, texts, memo) -> tuple[np.ndarray, np.ndarray]:
        """Tags of the tokens of each text, and where each text's tokens begin."""
        rows = texts.to_pylist()
        for gap in "\t\n\f\r":
            texts = pc.replace_substring(texts, gap, " ")
        parts = pc.split_pattern(texts, " ")
        starts = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        values = pc.binary_join(pa.ListArray.from_arrays(
            pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0]
        values = values.as_py().split(" ") if len(coded.dictionary) else []
        if "" in values:
            keep = codes != values.index("")
            kept = np.concatenate(([0], np.cumsum(keep)))
            starts, codes = kept[starts], codes[keep]
        table = np.empty((len(values), 9))
        for i, v in enumerate(values):
            table[i] = memo[v]
        of_file = np.array([self.file(t) for t in rows]).reshape(-1, 3)
        emission = table[codes, :3]
        emission += np.repeat(of_file, np.diff(starts), axis=0)
        inner = np.ones(len(codes) + 1, bool)
        inner[starts] = False
        at = np.flatnonzero(inner[:-1])
        emission[at] += table[codes[at - 1], 3:6]
        emission[at - 1] += table[codes[at], 6:]
        return self.decode(emission, starts), starts


def added_spans(text: str, tags: np.ndarray, base) -> list[tuple[int, int, str]]:
    """Spans of a text's tagged tokens that touch no base span."""
    if (tags == OUTSIDE).all():
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out, start, end = [], None, None
    for (a, b), tag in zip(tokens, tags.tolist(), strict=True):
        if start is not None and tag != INSIDE:
            out.append((start, end))
            start = None
        if tag != OUTSIDE:
            v, w = value_of(text[a:b])
            if start is None:
                start, end = a + v, a + w
            elif w > v:
                end = a + w
    if start is not None:
        out.append((start, end))
    ends = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []
    begins = [s for s, _, _ in base]
    return [(s, e, "crf") for s, e in out
            if s < e and not (i := bisect_left(begins, e)) > 0 or s < e and ends[i - 1] <= s]


# Fitting ------------------------------------------------------------------

def _windows(text: str, outside: bool):
    """Token windows around base spans, or one from the middle, with their tags."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    tags = np.full(len(tokens), OUTSIDE)
    ends = [b for _, b in tokens]
    for start, end, _ in base_spans(text):
        i = bisect_left(ends, start + 1)
        for j in range(i, len(tokens)):
            if tokens[j][0] >= end:
                break
            if tags[j] == OUTSIDE:
                tags[j] = BEGIN if j == i else INSIDE
    words = [text[a:b] for a, b in tokens]
    at = np.flatnonzero(tags == BEGIN).tolist()[:8] or ([len(tokens) // 2] if outside else [])
    for i in at:
        a = max(0, i - AROUND)
        yield words, tags, a, min(len(words), a + WINDOW)


def fit_field(texts: list[str], rounds: int = 120, penalty: float = 0.02) -> Field | None:
    """Maximum likelihood with a quadratic penalty, by forward-backward over the windows."""
    names: dict[str, int] = {}
    rows, gold, sizes = [], [], []
    for text in texts:
        of_file = ["file:" + f for f in file_features(text)]
        for words, tags, a, b in _windows(text, True):
            seen = [token_features(w) for w in words[max(0, a - 1):b + 1]]
            shift = a - max(0, a - 1)
            for i in range(a, b):
                j = i - a + shift
                found = ["own:" + f for f in seen[j][0]] + of_file
                if i:
                    found += ["left:" + f for f in seen[j - 1][1]]
                if i + 1 < len(words):
                    found += ["right:" + f for f in seen[j + 1][1]]
                rows.append([names.setdefault(f, len(names)) for f in found])
                gold.append(tags[i])
            sizes.append(b - a)
    gold = np.array(gold, int)
    if not (gold == BEGIN).any():
        return None
    width, spare = max(map(len, rows)), len(names)
    index = np.full((len(rows), width), spare)
    for i, r in enumerate(rows):
        index[i, :len(r)] = r
    longest, ends = max(sizes), np.cumsum(sizes)
    place = np.full((len(sizes), longest), -1)
    for i, (n, e) in enumerate(zip(sizes, ends, strict=True)):
        place[i, :n] = np.arange(e - n, e)
    live = place >= 0
    tags = np.where(live, gold[place], OUTSIDE)
    one = np.eye(3)
    weights, moves, first = np.zeros((spare + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    params = [weights, moves, first]
    square = [np.full(p.shape, 1e-6) for p in params]
    true_moves = sum(one[tags[:, t - 1]].T @ (one[tags[:, t]] * live[:, t:t + 1])
                     for t in range(1, longest))
    for _ in range(rounds):
        e = weights[index].sum(axis=1)
        x = np.where(live[:, :, None], e[place], 0.0)
        ahead, behind = np.zeros_like(x), np.zeros_like(x)
        ahead[:, 0] = first + x[:, 0]
        for t in range(1, longest):
            step = ahead[:, t - 1, :, None] + moves
            top = step.max(axis=1)
            new = top + np.log(np.exp(step - top[:, None]).sum(axis=1)) + x[:, t]
            ahead[:, t] = np.where(live[:, t:t + 1], new, ahead[:, t - 1])
        top = ahead[:, -1].max(axis=1, keepdims=True)
        total = top + np.log(np.exp(ahead[:, -1] - top).sum(axis=1, keepdims=True))
        g_moves = -true_moves + penalty * moves
        for t in range(longest - 1, 0, -1):
            step = moves + (x[:, t] + behind[:, t])[:, None, :]
            both = np.exp(ahead[:, t - 1, :, None] + step - total[:, :, None])
            g_moves += (both * live[:, t, None, None]).sum(axis=0)
            top = step.max(axis=2)
            new = top + np.log(np.exp(step - top[:, :, None]).sum(axis=2))
            behind[:, t - 1] = np.where(live[:, t:t + 1], new, behind[:, t])
        p = np.exp(ahead + behind - total[:, None, :])
        error = (p - one[tags])[live]
        g_weights = np.zeros_like(weights)
        by_row = np.zeros((len(rows), 3))
        by_row[place[live]] = error
        for tag in range(3):
            g_weights[:, tag] = np.bincount(
                index.ravel(), np.repeat(by_row[:, tag], width), spare + 1)
        g_weights += penalty * weights
        g_weights[spare] = 0
        g_first = (p[:, 0] - one[tags[:, 0]]).sum(axis=0) + penalty * first
        for param, g, s in zip(params, (g_weights, g_moves, g_first), square, strict=True):
            s += g * g
            param -= 0.5 * g / np.sqrt(s)
    return Field({n: weights[i].copy() for n, i in names.items()}, moves, first)


def fit(df: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Field | None:
    """Fit on a bounded sample of different whole texts of at most ``most_chars`` characters."""
    short, total = df.select("text").where(F.length("text") <= most_chars), df.count()
    guess = {True: total // MAYBE_ONE_IN, False: total}
    rows = smallest(short, F.col("text").rlike(MAYBE), guess, sample)
    found = rows.collect()
    texts = [t for side in (True, False) for t in sorted(r.text for r in found if r.side == side)]
    return fit_field(texts)


def _scanner(df: DataFrame, field: Field | None):
    """A function that gives the spans of each text of a slice."""
    small_batches(df.sparkSession)
    shared, memos = df.sparkSession.sparkContext.broadcast(field), {}

    def spans(texts) -> list[list[tuple[int, int, str]]]:
        field = shared.value
        rows = texts.to_pylist()
        base = [base_spans(t) for t in rows]
        if field is None:
            return base
        memo = memos.setdefault("memo", None) or memos.update(memo=Memo(field.table, 100_000)) \
            or memos["memo"]
        tags, starts = field.tag_slice(texts, memo)
        hit = np.flatnonzero(np.bincount(np.searchsorted(starts, np.flatnonzero(
            tags != OUTSIDE), "right") - 1, minlength=len(rows)))
        for i in hit.tolist():
            base[i] = sorted(
                base[i] + added_spans(rows[i], tags[starts[i]:starts[i + 1]], base[i]),
                key=lambda s: (s[0], KINDS.index(s[2])))
        return base

    return spans


def secret_spans(df: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, spans`` of every row, the spans as ``kind, start, end`` structs."""
    spans = _scanner(df, field)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def step(batch, texts):
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in row] for row in spans(texts)]
        return [batch.column("doc_id"), pa.array(found, pa.list_(item))]

    names, schema = ["doc_id", "spans"], \
        "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>"

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays(
                step(batch, pc.fill_null(batch.column("text"), "")), names=names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


def digests(df: DataFrame, field: Field | None) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    spans = _scanner(df, field)

    def step(batch, texts):
        rows = spans(texts)
        told = [[f"{k}:{s}:{e}" for s, e, k in row] for row in rows]
        base = [",".join(x for x in row if not x.startswith("crf:")) for row in told]
        return [batch.column("doc_id"),
                *[np.array([sum(s[2] == k for s in row) for row in rows], np.int64)
                  for k in KINDS[:3]],
                [hashlib.sha256(x.encode()).hexdigest() for x in base],
                [",".join(row) for row in told]]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, n_assign long, n_access long, n_hex long,"
                    "base_sha256 string, spans string", SLICE)


def secret_scan(df: DataFrame) -> DataFrame:
    return digests(df, fit(df))


def mask(text: str, spans) -> str:
    """The text with each secret replaced by a mark of its kind; spans that overlap are one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(df: DataFrame) -> DataFrame:
    """Rows of ``df`` with the secrets of their texts masked; null texts stay null.

    ``n_chars``, where the table has it, follows the new text.
    """
    spans = _scanner(df, fit(df))

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            column = batch.column("text")
            texts = pc.fill_null(column, "")
            found = spans(texts)
            hit = np.array([bool(x) for x in found]) & column.is_valid().to_numpy(
                zero_copy_only=False)
            if hit.any():
                rows = texts.to_pylist()
                new = pa.array([mask(rows[i], found[i]) for i in np.flatnonzero(hit)],
                               column.type)
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(
                    column, pa.array(hit), new))
            yield batch

    out = df.mapInArrow(run, df.schema)
    if "n_chars" in df.columns:
        kept = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", kept.cast(df.schema["n_chars"].dataType))
    return out
