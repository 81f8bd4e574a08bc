"""License scans (operator 9).

One Aho-Corasick automaton finds identifier tags and notice phrases in the words
of every whole text; behind a tag, a shunting-yard parser reads a licence
expression with AND, OR and WITH and evaluates it against the licences a user
accepts.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
after A-Z became a-z. A null text counts as empty: no words, no labels, score 0.
Phrases that share words count each. Repeated rows come out repeated; other
columns are not read. One pass, no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notices, with the identifier they stand for.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "released into the public domain": "public-domain",
}

# Tags that an expression follows.
TAGS = ("spdx license identifier", "license expression")

# Identifiers that count as known in an expression, and as accepted by default.
ACCEPTED = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc0-1.0", "isc",
            "mit", "unlicense", "zlib")
#: Share of certainty a kind of finding adds.
WEIGHTS = {"tag": 0.95, "notice": 0.8, "base": 0.6}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before A-Z became a-z
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDING = {"or": 1, "and": 2, "with": 3}


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, None if malformed."""
    out, stack, operand = [], [], False
    for token in tokens:
        if token in _BINDING:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            while operand and stack and stack[-1] != "(":
                out.append(stack.pop())
            if not operand or not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out if operand else None


def evaluate(postfix: list[str], accepted=ACCEPTED) -> bool:
    """Whether a user who accepts ``accepted`` may use what carries the expression."""
    stack: list = []
    for token in postfix:
        if token == "with":  # an exception only adds permissions to its licence
            stack.pop()
        elif token in _BINDING:
            right, left = stack.pop(), stack.pop()
            stack.append(left and right if token == "and" else left or right)
        else:
            stack.append(token.removesuffix("+") in accepted)
    return stack[0]


def read_expression(text: str, start: int) -> list[str]:
    """Tokens of the longest well-formed expression on the line from ``start`` on."""
    end = text.find("\n", start)
    tokens = [t.rstrip(".:").lower() or t for t in _TOKEN.findall(
        text, start, len(text) if end < 0 else end)]
    seen, operand = [], False
    for token in tokens:  # stop where one operand follows another: prose begins
        joins = token in _BINDING or token == ")"
        if operand and not joins:
            break
        seen.append(token)
        operand = token not in _BINDING and token != "("
    while seen and to_postfix(seen) is None:
        seen.pop()
    return seen


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS))):
        for phrase, label in phrases.items():
            entries.setdefault(phrase, []).append((kind, label, phrase.count(" ") + 1))
    for phrase, value in entries.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, value))
    found.make_automaton()
    return found


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
              for b in range(256))


def scan_text(text: str, accepted=ACCEPTED) -> dict:
    """Findings in one text: base places, labels, expressions with their verdicts, score."""
    words = text.encode().translate(_FOLD).split()
    line = f" {b' '.join(words).decode()} "
    places, base, labels, tags, weights = [], set(), {}, [], WEIGHTS
    spaces = seen = 0  # ends ascend, so that spaces are counted on from the last one
    for end, (_, entries) in _automaton().iter(line):
        spaces += line.count(" ", seen, end + 1)
        seen = end + 1
        word = spaces - entries[0][2] - 1
        for kind, label, length in entries:
            if kind == "tag":
                tags.append(word + length)
                continue
            if kind == "base":
                places.append(word)
                base.add(label)
            labels[label] = max(labels.get(label, 0.0), weights[kind])
    expressions = []
    if tags:
        ends = [m.end() for m in _WORD.finditer(text)]
        for after in tags:
            postfix = to_postfix(read_expression(text, ends[after - 1]))
            if postfix:
                expressions.append(f"{' '.join(postfix)}={str(evaluate(postfix, accepted)).lower()}")
                for token in postfix:
                    if token not in _BINDING:
                        labels[token] = weights["tag"]
    score = 1.0
    for label in sorted(labels):
        score *= 1 - labels[label]
    return {"n_words": len(words), "places": places, "base": sorted(base),
            "labels": sorted(labels), "expressions": expressions, "score": 1 - score}


def license_scan(df: DataFrame, accepted=ACCEPTED) -> DataFrame:
    """``doc_id, n_words, base_words, base_labels, labels, expressions, score`` per row.

    ``base_words`` holds the word at which each base phrase begins, ``expressions``
    each expression in postfix order with its verdict.
    """
    accepted = tuple(accepted)

    def step(batch, texts):
        rows = [scan_text(t, accepted) for t in texts.to_pylist()]
        return [batch.column("doc_id"), np.array([r["n_words"] for r in rows], np.int64),
                pa.array([r["places"] for r in rows], pa.list_(pa.int64())),
                *[pa.array([r[c] for r in rows], pa.list_(pa.string()))
                  for c in ("base", "labels", "expressions")],
                np.array([r["score"] for r in rows], np.float64)]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, n_words long, base_words array<long>, base_labels array<string>,"
                    "labels array<string>, expressions array<string>, score double")


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.selectExpr(
        "doc_id", "n_words", "cast(size(base_words) as bigint) AS n_base",
        "array_min(base_words) AS first_word", "array_max(base_words) AS last_word",
        "array_join(base_labels, ',') AS base_labels", "array_join(labels, ',') AS labels",
        "score", "array_join(expressions, ';') AS expressions")
