"""The same operators on Structured Streaming inputs.

Checks, corrections, split and protection hold no state: the batch functions run
unchanged on a stream. Models and the column mapping are fitted in batch and
enter the streaming projection as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import Pseudonymizer
from ..functions.sql import any_of, ident, select
from ..operators import accounts
from ..operators import evaluate as ev
from ..operators.numeric import OutlierModel
from ..operators.protection import protect
from ..operators.resolve import key_rows
from ..operators.skew import attach
from ..session import materialize
from ..sources.io import append_batch, nan_to_null


@dataclass(frozen=True)
class StreamCleaner:
    """A fitted cleaning step: mapping, models and options, ready for any frame."""

    fields: dict[str, str]
    models: dict[str, OutlierModel] = field(default_factory=dict)
    apply_normalizations: bool = True
    quarantine_on: str = "error"
    pseudonymize: bool = False
    mask_output: bool = False
    keyed: Pseudonymizer | None = None
    row_id: str = ev.ROW_ID

    def evaluate(self, frame: DataFrame) -> DataFrame:
        return ev.evaluate(nan_to_null(frame), self.fields, self.models)

    def findings(self, frame: DataFrame, *carry: str) -> DataFrame:
        return ev.findings(self.evaluate(frame), *carry, row_id=self.row_id)

    def sides(self, frame: DataFrame) -> DataFrame:
        """Both sides of the split in one frame, told apart by ``side``; one evaluation.

        Where protection turns a number into text, the quarantined rows' is text too.
        """
        table = ev.corrected(self.evaluate(frame), self.fields, self.apply_normalizations)
        names = [c for c in table.columns if c != "__level"]
        both = select(table, {"__raw": f"struct({', '.join(map(ident, names))})"})
        safe = protect(both, self.fields, self.pseudonymize, self.mask_output, self.keyed)
        passed = f"__level < {ev.fixed.LEVEL[self.quarantine_on]}"
        types = {f.name: f.dataType.simpleString() for f in safe.schema.fields}
        return safe.selectExpr(
            *[f"IF({passed}, {ident(c)}, CAST(__raw.{ident(c)} AS {types[c]})) AS {ident(c)}"
              for c in names], f"IF({passed}, 'valid', 'quarantine') AS side")

    def split(self, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        table = ev.corrected(self.evaluate(frame), self.fields, self.apply_normalizations)
        valid, quarantine = ev.split(table, self.quarantine_on)
        valid = protect(valid, self.fields, self.pseudonymize, self.mask_output, self.keyed)
        return valid, quarantine


def write_split(stream: DataFrame, cleaner: StreamCleaner, path: str, checkpoint: str):
    """Both sides of a stream in one sink: ``path/batch=<id>/side=valid|quarantine``.

    A micro-batch is evaluated once and owns its folder, which a replay overwrites, so
    a restart neither loses nor repeats rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(cleaner.sides(batch), path, batch_id, "side")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_side(spark: SparkSession, path: str, side: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("side") == side).drop("side", "batch")


# --- windows -----------------------------------------------------------------

def _earlier(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What earlier batches have written; nothing before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], f"{schema}, batch long")
    table = spark.read.schema(f"{schema}, batch long").parquet(path)
    return table.where(F.col("batch") < batch_id)


_WINDOWS = "window_start timestamp, window_end timestamp, rule string, count bigint"


def write_windows(findings: DataFrame, path: str, checkpoint: str, ts: str = "ts",
                  width: str = "1 hour", lateness: str = "2 hours"):
    """Findings per rule and time window, no row lost: ``path/closed`` and ``path/late``.

    A window closes once, when the watermark (the latest time of any batch less
    ``lateness``) has passed its end; rows that come after that are counted in ``late``.
    Closed and late counts together are those of the batch. A micro-batch counts its
    rows first and keeps the counts by day; it reads the days that it closes.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = materialize(batch.groupBy(F.window(ts, width).alias("w"), "rule").agg(
            F.count("*").alias("count"), F.max(ts).alias("last")).select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule",
            "count", "last", F.to_date("w.start").alias("day")), "windows")
        marks = _earlier(spark, f"{path}/marks", batch_id, "mark timestamp")
        mark = marks.agg(F.max("mark")).head()[0]
        moved = parts.agg(F.expr(f"max(last) - INTERVAL {lateness}").alias("mark")).select(
            F.greatest("mark", F.lit(mark).cast("timestamp")).alias("mark"))
        append_batch(moved, f"{path}/marks", batch_id)
        new = spark.read.parquet(f"{path}/marks/batch={batch_id}").head()[0]
        is_late = F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark)
        append_batch(parts.where(is_late).select(*_names(_WINDOWS)), f"{path}/late", batch_id)
        append_batch(parts.where(~is_late).select(*_names(_WINDOWS), "day"), f"{path}/open",
                     batch_id, "day")
        append_batch(_closing(spark, path, mark, new, batch_id), f"{path}/closed", batch_id)

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


def _closing(spark, path, mark, new, batch_id) -> DataFrame:
    """Windows whose end the watermark passes on its way from ``mark`` to ``new``."""
    open_ = spark.read.schema(f"{_WINDOWS}, batch long, day date").parquet(f"{path}/open")
    ends = F.col("window_end") <= F.lit(new) if new is not None else F.lit(True)
    days = F.col("day") <= F.to_date(F.lit(new)) if new is not None else F.lit(True)
    if mark is not None:  # a window is shorter than a day or begins on an earlier one
        ends &= F.col("window_end") > F.lit(mark)
    return open_.where((F.col("batch") <= batch_id) & days & ends).groupBy(
        "window_start", "window_end", "rule").agg(F.sum("count").alias("count"))


def close_windows(spark: SparkSession, path: str) -> None:
    """Close what is still open: the stream has ended."""
    marks = spark.read.parquet(f"{path}/marks")
    last, mark = marks.agg(F.max("batch"), F.max("mark")).head()
    append_batch(_closing(spark, path, mark, None, last), f"{path}/closed", last + 1)


def read_windows(spark: SparkSession, path: str, side: str = "closed") -> DataFrame:
    return spark.read.schema(f"{_WINDOWS}, batch long").parquet(f"{path}/{side}")


# --- usage -------------------------------------------------------------------

def upsert(updates: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Write ``updates`` over the rows of ``path`` with the same keys.

    Only partitions that they touch are read and written again, each as a whole, so
    that writing the same updates twice leaves the same table. The touched partitions
    are listed on the driver: ``partition`` should have few values (months, buckets).
    """
    spark, updates = updates.sparkSession, materialize(updates, "updates")
    touched = [r[0] for r in updates.select(partition).distinct().collect()]
    if not touched:
        return
    rows = updates
    try:
        table = spark.read.schema(updates.schema).parquet(path)
    except AnalysisException:  # nothing there yet
        table = None
    if table is not None:
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        kept = table.where(F.col(partition).isin(touched)).alias("a").join(
            updates.alias("b"), same, "left_anti")
        rows = materialize(kept.unionByName(updates), "merged")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition).parquet(path)


def usage_stream(runs: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Monthly usage of a run stream, for an update-mode sink."""
    return accounts.monthly_usage(runs.withWatermark("created_at", lateness))


def write_usage(runs: DataFrame, path: str, checkpoint: str, lateness: str = "7 days"):
    """A table of monthly usage, by month, kept up to date by a stream of runs."""
    def write(updates: DataFrame, batch_id: int) -> None:
        upsert(updates, path, ["org_id", "period"], "period")

    return usage_stream(runs, lateness).writeStream.outputMode("update").foreachBatch(
        write).option("checkpointLocation", checkpoint)


def relevant_events_stream(events: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Each relevant billing event once, with state bounded by the watermark."""
    return (
        events.where(any_of("type", accounts.HANDLED_EVENTS)).withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


# --- request limits -------------------------------------------------------------

_BUCKET = "key string, tokens double, seen double"


def write_limits(log: DataFrame, path: str, checkpoint: str):
    """Token buckets of a live request log: ``path/answers``, and ``path/buckets`` as state.

    A micro-batch is replayed like a log that begins with the buckets the one before
    has left: cut where a bucket is surely full, in sorted streams, so a hot key's
    batch is not gathered. The state of a batch is written with it and holds the keys
    that were active within the last minute of the log; others are full again.
    Batches should come in the order of time, rows within one in any.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = _earlier(spark, f"{path}/buckets", batch_id, _BUCKET).where(
            F.col("batch") == batch_id - 1).drop("batch")
        told = accounts.replayed_requests(batch, start if batch_id else None)
        append_batch(told, f"{path}/answers", batch_id)
        told = spark.read.schema(told.schema).parquet(f"{path}/answers/batch={batch_id}")
        append_batch(accounts.buckets_left(told, start), f"{path}/buckets", batch_id)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# --- key registry ------------------------------------------------------------------

_KEYS = "key_type string, key string, hash bigint, head bigint"
BUCKETS = 64
#: Up to so many keys of a batch are looked up by their hashes, through the files' Bloom filters.
FEW_KEYS = 2_000


def known_keys(spark: SparkSession, path: str, wanted: DataFrame, batch_id: int) -> DataFrame:
    """Registered keys among which all of ``wanted`` (hash, bucket) are that any batch has seen.

    Only the buckets of the wanted keys are opened; of a few keys, only the row groups
    whose Bloom filters or ranges may hold one.
    """
    table = _earlier(spark, f"{path}/keys", batch_id, f"{_KEYS}, bucket int")
    sizes = dict(wanted.groupBy("bucket").count().collect())  # at most one row per bucket
    table = table.where(F.col("bucket").isin(list(sizes)))
    if sum(sizes.values()) <= FEW_KEYS:
        table = table.where(F.col("hash").isin([r[0] for r in wanted.select("hash").collect()]))
    return table.select("key_type", "key", "head")


def register_keys(stream: DataFrame, fields: dict[str, str], path: str, checkpoint: str,
                  row_id: str = ev.ROW_ID, buckets: int = BUCKETS):
    """Exact-key duplicates of a stream against every key seen before.

    ``path/keys`` remembers the first row of each key, in buckets of key hashes;
    ``path/links`` the rows that repeat one. A micro-batch reads earlier batches'
    entries in its own buckets and overwrites its own folders, so replays are
    harmless. Rows of hot keys meet their first row through ``attach``. Names and
    groups stay in batch.
    """
    exact = {f: c for f, c in fields.items() if f in ev.fixed.KEY_CONFIDENCE}
    key = ["key_type", "key"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(key_rows(batch, exact, row_id).select("row_id", *key), "rows")
        firsts = rows.groupBy(*key).agg(
            F.min("row_id").alias("first"), F.count("*").alias("n")).withColumn(
            "hash", F.xxhash64(*key))
        firsts = materialize(firsts.withColumn(
            "bucket", F.expr(f"CAST(pmod(hash, {buckets}) AS INT)")), "firsts")
        known = known_keys(spark, path, firsts, batch_id)
        heads = materialize(firsts.join(known, key, "left").withColumn(
            "fresh", F.col("head").isNull()).withColumn("head", F.coalesce("head", "first")), "heads")
        heads.where("fresh").select(*key, "hash", "head", "bucket").repartition(
            "bucket").sortWithinPartitions("bucket", "hash").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#hash", "true").partitionBy("bucket").parquet(
            f"{path}/keys/batch={batch_id}")
        links = attach(rows, heads.select(*key, "head", "n"), key, "n").where("row_id <> head")
        append_batch(links.select("row_id", "head", *key), f"{path}/links", batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def key_links(spark: SparkSession, path: str) -> DataFrame:
    """Registered links as the batch gives them: to the smallest row of the key.

    While rows come in order that is the first one anyway.
    """
    key = ["key_type", "key"]
    links = spark.read.schema(
        "row_id bigint, head bigint, key_type string, key string").parquet(f"{path}/links")
    groups = materialize(links.groupBy(*key).agg(
        F.min(F.least("row_id", "head")).alias("smallest"), F.min("head").alias("head"),
        (F.count("*") + 1).alias("n")), "groups")
    rows = links.select("row_id", *key).unionByName(
        groups.select(F.col("head").alias("row_id"), *key))
    return attach(rows, groups.select(*key, "smallest", "n"), key, "n").where(
        "row_id <> smallest").select("row_id", F.col("smallest").alias("head"), *key)
