"""Personal data (operator 13).

Four base patterns mark e-mail addresses, IP addresses, payment cards and phone
numbers by form. A character-level bidirectional LSTM with CRF transitions
(``char_tagger``), trained here from base spans, adds other spellings: letters
beyond ASCII, other separators, a missing prefix. Base spans stay; an added span
keeps off every one of them and must hold what its kind cannot do without (``holds``).

The tagger reads windows of ``WINDOW`` characters that begin every ``STRIDE``, so
each stretch of up to ``WINDOW - STRIDE`` characters lies whole in one of them.
Every span holds a digit or an at sign, so windows without one have none and are
not computed. Windows are decoded each on its own and reconciled over the whole
text: pieces cut by the edge of a window are joined with their other half, and of
spans that overlap, those with the largest sum of log-odds against "no span" stay.

It is fitted on at most ``SAMPLE`` different texts with a digit or an at sign, of
at most ``SAMPLE_CHARS`` characters, and ``TRAIN`` windows of these; half of the
labelled windows show their span in another spelling. Windows with a base match
that failed its check are not learned from. Without base spans in the sample
nothing is added.

A null text counts as empty: no spans. Offsets are code points. Repeated rows come
out repeated; other columns are not read. One pass to scan, no shuffle.
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

from .char_tagger import PAD, Tagger, symbols
from .common import per_text, slices

# Kinds and base patterns with their limits.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever it starts, so no digit is read twice
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MOST_IP, CARD_DIGITS, PHONE_DIGITS = 255, (12, 19), (9, 15)

ADDED = tuple("lstm_" + k for k in KINDS)
WINDOW, STRIDE = 96, 48
SAMPLE, SAMPLE_CHARS, TRAIN, ROUNDS = 600, 20_000, 768, 14
#: Log-odds that an added span needs, and windows that are computed at once.
SURE, CHUNK = 3.0, 256

_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_GROUP = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    """The check of payment card numbers, over ASCII digits."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def small_number(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= MOST_IP


def matches(text: str) -> list[tuple[int, int, str, bool]]:
    """``(start, end, kind, passes)`` of every match of the base patterns, linear in the text."""
    out = []
    if "@" in text:
        done = 0  # where the last match ended
        for m in DOMAIN.finditer(text):
            before = text[done:m.start()]
            name = len(before) - len(before.rstrip(LOCAL))
            if name:
                out.append((m.start() - name, m.end(), "email", True))
                done = m.end()
    if _TRIGGER.search(text) is None:
        return out
    for m in NUMBERS.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())] if "." in m.group() else ()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k:k + 4]
            out.append((four[0][0], four[3][1], "ip", all(small_number(text[a:b]) for a, b in four)))
    for m in CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        out.append((*m.span(), "card", CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1]
                    and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = len(_NOT_DIGIT.sub("", m.group()))
            out.append((*m.span(), "phone", PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]))
    return out


def in_order(spans: list, kinds=KINDS + ADDED) -> list:
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)``, by start, then by kind as listed."""
    return in_order([m[:3] for m in matches(text) if m[3]])


def holds(text: str, kind: str) -> bool:
    """What a span of a kind cannot do without, however it is spelled."""
    digits = "".join(c for c in text if c.isdecimal())
    digits = "".join(str(int(c)) for c in digits)
    if kind == "email":
        name, at, place = text.partition("@")
        return bool(at) and any(map(str.isalnum, name)) and any(map(str.isalnum, place)) \
            and not any(map(str.isspace, text))
    if kind == "ip":
        groups = re.findall(r"\d+", text)
        return len(groups) == 4 and all(small_number(g) for g in groups)
    if kind == "card":  # the same gap throughout
        gaps = {g for g in re.split(r"\d+", text) if g}
        return len(gaps) <= 1 and CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1] and not text.isdecimal() \
        and not any(map(str.isalpha, text))


# Windows ------------------------------------------------------------------

def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign, every ``STRIDE`` characters."""
    out, last, end = [], -1, max(0, -(-(len(text) - WINDOW) // STRIDE))
    m = _TRIGGER.search(text)
    while m is not None:
        at = m.start()
        first, final = max(last + 1, -(-(at - WINDOW + 1) // STRIDE), 0), min(at // STRIDE, end)
        out += range(first * STRIDE, (final + 1) * STRIDE, STRIDE)
        last = max(last, final)
        # Up to the next start, characters lie in the same windows.
        m = _TRIGGER.search(text, (final + 1) * STRIDE if final < end else len(text))
    return out


def window_ids(ids: np.ndarray, starts: list[int]) -> np.ndarray:
    """Symbols of windows, filled up at the end of the text."""
    padded = np.concatenate([ids, np.full(WINDOW, PAD, np.uint8)])
    return padded[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)]


def pieces(tags: np.ndarray, e: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """``(start, end, kind, log-odds)`` of the spans in a window's tags, against no span there."""
    out, t, width = [], 0, len(tags)
    while t < width:
        if tags[t] == 0:
            t += 1
            continue
        a, kind = t, (tags[t] - 1) // 2
        t += 1
        while t < width and tags[t] == 2 * kind + 2:
            t += 1
        own, place = tags[a:t], np.arange(a, t)
        gain = (e[place, own] - e[place, 0]).sum()
        steps = np.concatenate([tags[max(a - 1, 0):t], tags[t:t + 1]])
        plain = steps.copy()
        plain[a - max(a - 1, 0):t - max(a - 1, 0)] = 0
        gain += (moves[steps[:-1], steps[1:]] - moves[plain[:-1], plain[1:]]).sum()
        if a == 0:
            gain += first[tags[0]] - first[0]
        out.append((a, t, int(kind), float(gain)))
    return out


def joined(found: list, length: int) -> list:
    """Pieces of one text with those cut by the edge of a window joined to their other halves.

    ``found``: ``(window's start, start, end, kind, log-odds)``, offsets in the text.
    """
    whole, cut = set(), []
    for window, a, b, kind, odds in found:
        left, right = a == window and a > 0, b == window + WINDOW and b < length
        if left or right:
            cut.append((a, b, kind, odds))
        else:
            whole.add((a, b, kind, odds))
    out = {}
    for a, b, kind, odds in whole:
        out[a, b, kind] = max(odds, out.get((a, b, kind), odds))
    for kind in {c[2] for c in cut}:
        chain = None  # start, end, log-odds and characters so far
        own = sorted(c for c in [*cut, *((a, b, k, o) for (a, b, k), o in out.items())]
                     if c[2] == kind)
        for a, b, _, odds in [*own, (length + 2, length + 2, kind, 0.0)]:
            if chain and a <= chain[1]:
                chain = (chain[0], max(chain[1], b), chain[2] + odds, chain[3] + b - a)
                continue
            if chain:
                x, y, total, size = chain
                out[x, y, kind] = max(total * (y - x) / size, out.get((x, y, kind), -np.inf))
            chain = (a, b, odds, b - a)
    return [(*k, o) for k, o in out.items()]


def reconcile(spans: list) -> list:
    """The spans that do not overlap and have the largest sum of log-odds.

    ``spans``: ``(start, end, kind, log-odds)``; ties go to fewer spans that end first.
    """
    spans = sorted((s for s in spans if s[3] > 0), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    best, take = [0.0], []
    for i, (start, _, _, odds) in enumerate(spans):
        with_it = best[bisect_left(ends, start + 1, 0, i)] + odds
        take.append(with_it > best[i])
        best.append(max(best[i], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1]:
            out.append(spans[i - 1])
            i = bisect_left(ends, spans[i - 1][0] + 1, 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """``(start, end, kind, log-odds)`` that the tagger alone finds in each text."""
    out: list[list] = [[] for _ in texts]
    waiting, ids, moves = [], [], model.chain()

    def decode():
        e = model.emissions(np.concatenate(ids))
        for (i, start), tags, own in zip(waiting, model.viterbi(e), e, strict=True):
            if tags.any():
                out[i] += [(start, start + a, start + b, k, odds)
                           for a, b, k, odds in pieces(tags, own, *moves)]
        waiting.clear()
        ids.clear()

    for i, text in enumerate(texts):
        starts = window_starts(text)
        known = symbols(text) if starts else None
        for a in range(0, len(starts), CHUNK):
            some = starts[a:a + CHUNK]
            ids.append(window_ids(known, some))
            waiting += [(i, s) for s in some]
            if len(waiting) >= CHUNK:
                decode()
    if waiting:
        decode()
    return [[(a, b, KINDS[k], odds) for a, b, k, odds in reconcile(joined(f, len(t)))] if f else []
            for f, t in zip(out, texts, strict=True)]


def added_spans(text: str, found: list, base: list) -> list[tuple[int, int, str]]:
    """Tagged spans that are sure, hold what they must and touch no base span."""
    ends = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []
    begins, out = [s for s, _, _ in base], []
    for a, b, kind, odds in found:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        i = bisect_left(begins, b)
        if odds >= SURE and a < b and (i == 0 or ends[i - 1] <= a) and holds(text[a:b], kind):
            out.append((a, b, "lstm_" + kind))
    return out


# Training -----------------------------------------------------------------

_SEPARATORS = (" ", "-", ".", "/", " ", "  ")
_ACCENTS = "áàâäçéèêëíïñóôöúùûüß"


def respelled(text: str, kind: str, rng) -> str:
    """The same datum as people also write it."""
    if kind == "email":
        at = [i for i, c in enumerate(text) if c.isalpha()]
        for i in rng.choice(at, min(len(at), 2), replace=False) if at else ():
            text = text[:i] + _ACCENTS[rng.integers(len(_ACCENTS))] + text[i + 1:]
        return text
    if kind == "ip":
        return text.replace(".", (" . ", ". ", "·")[rng.integers(3)])
    if kind == "card":
        digits = _NOT_DIGIT.sub("", text)
        gap = _SEPARATORS[rng.integers(len(_SEPARATORS))]
        return gap.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    digits = _NOT_DIGIT.sub("", text)
    local = digits[-min(len(digits), 10):]
    style = rng.integers(4)
    if style == 0:
        return f"({local[:3]}) {local[3:6]}-{local[6:]}"
    gap = _SEPARATORS[rng.integers(4)]
    if style == 1:
        return gap.join((local[:3], local[3:6], local[6:]))
    if style == 2:
        return "00" + gap.join((digits[:-10] or "1", local[:3], local[3:6], local[6:]))
    return "+" + gap.join((digits[:-10] or "1", local[:3], local[3:6], local[6:]))


def training_windows(texts: list[str], most: int = TRAIN, seed: int = 3):
    """Symbols and tags of windows around spans, and of others with a digit or an at sign."""
    rng, with_span, without = np.random.default_rng(seed), [], []
    for text in texts:
        found = matches(text)
        failed = [(a, b) for a, b, kind, passes in found
                  if not passes and len(_NOT_DIGIT.sub("", text[a:b])) >= PHONE_DIGITS[0]]
        spans, reach = [], -1
        for s in sorted((m[:3] for m in found if m[3]), key=lambda s: (s[0], -s[1])):
            if s[1] > reach:  # not a card within a phone
                spans.append(s)
                reach = s[1]
        for start, end, kind in spans[:12]:
            if end - start <= WINDOW // 2:
                with_span.append((text, start, end, kind, spans, failed))
        for start in window_starts(text)[:12]:
            if not any(a < start + WINDOW and start < b for a, b, _ in spans) \
                    and not any(a < start + WINDOW and start < b for a, b in failed):
                without.append(text[start:start + WINDOW])
    ids, tags = [], []

    def learn(text, marked):
        row = np.zeros(WINDOW, np.int64)
        for a, b, kind in marked:
            k = KINDS.index(kind)
            if a < WINDOW and b > 0:
                row[max(a, 0):b] = 2 * k + 2
                row[max(a, 0)] = 2 * k + 1
        ids.append(window_ids(symbols(text[:WINDOW]), [0])[0])
        tags.append(row)

    # Each kind gets the same share, whatever its frequency.
    by_kind = [[w for w in with_span if w[3] == k] for k in KINDS]
    by_kind = [[own[i] for i in rng.permutation(len(own))] for own in by_kind]
    share = 2 * most // 3 // max(1, sum(map(bool, by_kind)))
    for own in by_kind:
        for n in range(share if own else 0):
            text, start, end, kind, spans, failed = own[n % len(own)]
            left = max(0, start - int(rng.integers(0, WINDOW - (end - start))))
            value = text[start:end]
            if n % 2:
                value = respelled(value, kind, rng)
            shift = len(value) - (end - start)
            window = text[left:start] + value + text[end:left + WINDOW]
            near = [(a, b, k) if b <= start else (a + shift, b + shift, k)
                    for a, b, k in spans if b <= start or a >= end]
            if any(a < left + WINDOW and left < b and not (start <= a and b <= end)
                   for a, b in failed):
                continue
            learn(window, [(a - left, b - left, k) for a, b, k in
                           [*near, (start, start + len(value), kind)]])
    for i in rng.permutation(len(without))[:most // 3].tolist():
        learn(without[i], [])
    return (np.array(ids), np.array(tags)) if any(map(bool, by_kind)) and ids else (None, None)


def fit_texts(texts: list[str], most: int = TRAIN, rounds: int = ROUNDS) -> Tagger | None:
    ids, tags = training_windows(texts, most)
    if ids is None:
        return None
    model = Tagger(len(KINDS))
    model.fit(ids, tags, rounds)
    return model


def sample_texts(df: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> list[str]:
    """Different texts with a digit or an at sign, those of the smallest hashes.

    A share of the hashes is let through before texts are looked into; it grows until
    enough texts pass.
    """
    rows = df.select("text").where(F.length("text") <= most_chars)
    own, share = F.xxhash64("text"), max(1, df.count() // (16 * sample))
    while True:
        some = rows.where(F.pmod(own, F.lit(share)) == 0) if share > 1 else rows
        found = some.where(F.col("text").rlike("[0-9@]")).distinct().orderBy(
            own, "text").limit(sample).collect()
        if len(found) == sample or share == 1:
            return sorted(r.text for r in found)
        share = max(1, share // 16)


def fit(df: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Tagger | None:
    """Fit on a bounded sample of whole texts."""
    return fit_texts(sample_texts(df, sample, most_chars))


# Scanning -----------------------------------------------------------------

def spans_of(model: Tagger | None, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Base and added spans of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return base
    return [in_order(b + added_spans(t, f, b)) if f else b
            for t, f, b in zip(texts, tagged(model, texts), base, strict=True)]


def personal_spans(df: DataFrame, model: Tagger | None) -> DataFrame:
    """``doc_id, spans`` of every row, the spans with kind, offsets and what they hold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("value", pa.string())])

    def step(batch, texts):
        rows = texts.to_pylist()
        found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in spans]
                 for t, spans in zip(rows, spans_of(shared.value, rows), strict=True)]
        return [batch.column("doc_id"), pa.array(found, pa.list_(item))]

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                step(batch, pc.fill_null(batch.column("text"), "")), names=["doc_id", "spans"])

    return df.select("doc_id", "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, "
             "value: string>>")


def digests(df: DataFrame, model: Tagger | None) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batch, texts):
        rows = spans_of(shared.value, texts.to_pylist())
        told = [[(k, f"{k}:{a}:{b}") for a, b, k in row] for row in rows]
        base = [",".join(x for k, x in row if k in KINDS) for row in told]
        return [batch.column("doc_id"),
                *[np.array([sum(s[2] == k for s in row) for row in rows], np.int64) for k in KINDS],
                [hashlib.sha256(x.encode()).hexdigest() for x in base],
                [",".join(x for _, x in row) for row in told]]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, n_email long, n_ip long, n_card long, n_phone long,"
                    "base_sha256 string, spans string")


def personal_data(df: DataFrame) -> DataFrame:
    return digests(df, fit(df))
