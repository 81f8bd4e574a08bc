"""What the operators share: bounded slices of Arrow batches, words, hashing, shared tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

__all__ = ["load", "materialize", "slices", "gathered", "small_batches", "per_text", "words_of", "mix64",
           "unmix64", "Memo", "sums", "settle"]

#: Bytes of text that one step of a task works on at once; a longer text is one slice.
SLICE_BYTES = 4 << 20


def settle() -> None:
    """Give freed memory back to the system: Spark keeps a worker for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which needs no such call
        pass


#: Rows and bytes that go to a Python worker at once, where the session keeps Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"),
           "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(16 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: hand over fewer at once. What the user has set stays."""
    for name, (usual, small) in BATCHES.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of ``column``.

    Memory goes back to the system when the batches are through.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    settle()


def gathered(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Like ``slices``, but small batches come together until they hold ``limit`` bytes."""
    held, size = [], 0
    for part in slices(batches, column, limit):
        more = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size + more > limit:
            yield _one(held)
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield _one(held)


def _one(batches: list) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else \
        pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def per_text(df: DataFrame, step: Callable, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``step(slice, texts)`` over ``df``; it gets whole texts (null: empty), and returns arrays."""
    names = [f.split()[0] for f in schema.split(",")]
    small_batches(df.sparkSession)

    def run(batches):
        for batch in slices(batches, limit=limit):
            texts = pc.fill_null(batch.column("text"), "")
            out = step(batch, texts)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x
                                                  for x in out], names=names)

    return df.mapInArrow(run, schema)


def words_of(texts: pa.Array, pattern: str = r"[^\p{L}\p{N}]+"):
    """Lower-cased words of each text.

    ``pattern`` must split at spaces at least. Returns ``(starts, codes, values)``: where each text's words begin (one more
    entry than texts), the words as codes, and the distinct words.
    """
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), pattern)
    coded = parts.flatten().dictionary_encode()
    rows = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()),
                                    coded.dictionary)
    values = pc.binary_join(rows, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    if "" in values:  # separators at the ends of a text leave empty strings
        keep = codes != values.index("")
        kept = np.concatenate(([0], np.cumsum(keep)))
        starts, codes = kept[starts], codes[keep]
    return starts, codes, values


_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator; ``x`` is uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


_BACK1, _BACK2 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (_MUL1, _MUL2))


def unmix64(x: np.ndarray) -> np.ndarray:
    """What ``mix64`` has made ``x`` of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _BACK2
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _BACK1
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``starts``; empty stretches give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype),
                            np.cumsum(values, axis=0)))
    return total[starts[1:]] - total[starts[:-1]]


class Memo(dict):
    """Remembers ``make(key)``; at most two generations of ``limit`` keys stay in memory."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
