"""BPE encoding and decoding (operator 1).

Every whole text is encoded by a priority queue of merge ranks over a doubly
linked list of symbols, and decoded by concatenating the vocabulary strings of
its ids. A null text counts as empty: no ids, empty decoded text. Repeated rows
come out repeated; other columns are not read. No shuffle: one pass over the
table, bounded memory per slice of text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import encoding
from .common import per_text


def _joined(starts, codes, values: list, kind: pa.DataType, by) -> list:
    taken = pa.array(values, kind).take(pa.array(codes))
    rows = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), taken)
    return pc.binary_join(rows, pa.scalar(by, kind)).to_pylist()


def bpe_texts(df: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the ids as an array and the decoded text, per row."""
    path = path or encoding.default_path()

    def step(batch, texts):
        starts, codes, values = encoding.chunks(texts)
        made = encoding.coder("queue", path).entries(values)
        at, ids = encoding.gather(starts, codes, [m[0] for m in made])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("int32")))
        decoded = _joined(starts, codes, [m[2] for m in made], pa.large_binary(), b"")
        return [batch.column("doc_id"), lists,
                pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, ids array<int>, decoded string")


def bpe_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, without shipping the ids.

    The digests are taken where the ids are made; they equal those of
    ``bpe_texts``.
    """
    path = path or encoding.default_path()

    def step(batch, texts):
        starts, codes, values = encoding.chunks(texts)
        made = encoding.coder("queue", path).entries(values)
        at, _ = encoding.gather(starts, codes, [m[0] for m in made])
        # A chunk without ids (the empty text) must not leave a comma behind.
        listed = _joined(starts, codes, [m[1] for m in made], pa.large_string(), ",")
        decoded = _joined(starts, codes, [m[2] for m in made], pa.large_binary(), b"")
        return [batch.column("doc_id"), pa.array(at[1:] - at[:-1], pa.int64()),
                [hashlib.sha256(x.encode()).hexdigest() for x in listed],
                [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest()
                 for x in decoded]]

    return per_text(df.select("doc_id", "text"), step,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
