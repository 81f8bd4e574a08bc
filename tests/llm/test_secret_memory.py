"""Memory of the secret stage is that of a short stretch of text."""

import tracemalloc

import pyarrow as pa

from tersa.llm import secret_scan


class _Frame:
    """Takes the function that the stage hands to Spark."""

    columns, schema = ["doc_id", "text"], None

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_a_large_batch_is_tagged_in_short_stretches(spark, monkeypatch):
    words = ["alpha", "beta", "password=abcdef123", "gamma", "delta9"]
    field = secret_scan.fit_field([" ".join(words * 4), "a plain text of some words " * 4], 5)
    monkeypatch.setattr(secret_scan, "fit", lambda df: field)
    frame = secret_scan.mask_secrets(_Frame(spark))
    text = "one two three four five " * 40
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4_000)), "text": [text] * 4_000})
    tracemalloc.start()
    rows = sum(b.num_rows for b in frame.run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4_000 and peak < 60e6, peak
