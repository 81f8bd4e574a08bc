"""Subscription state of a stream of billing events that come in any order.

What an event writes is a set of maxima by ``(ts, event_id)``, so events that name
their organisation are folded per batch and merged whenever they come, twice as well
as once. An event without a name belongs to the organisation that held its customer at
the time, which events that come later may change. Such events wait by customer, and
a batch resolves anew the customers it touches: those of its own events, and those that
an organisation with news of its customer has ever held. Their result replaces
the earlier one of the same customers; nobody else is read.

What a look-up needs of an event that names its organisation is who held whom since when,
a narrow row; such events are never read again. A fact or event that comes twice weighs
nothing: all of it are maxima and the last rows before a time.

Tables under ``path``, each in folders of its batch, replaced when it is replayed:
``named`` (folds), ``events`` (those without a name, by bucket of the customer), ``held``
(who held whom, by bucket of the organisation), ``holders`` and ``holdings`` (different
pairs of both, by bucket of the customer and of the organisation), ``resolved`` (folds of
customers, the latest batch counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import select
from ..operators import accounts
from ..session import materialize
from ..sources.io import append_batch

BUCKETS = 32
_LATEST = ("plan", "status", "cancel_at_period_end")
_KEPT = ("customer", "subscription", "period_end")
_NAMED = "coalesce(nullif(org_id, ''), nullif(client_reference_id, ''))"


def fold(changes: DataFrame, *by: str) -> DataFrame:
    """The latest value of each column, with its time, mergeable by ``merge``."""
    def told(name, when=""):
        value = f"named_struct('ts', ts, 'event_id', event_id, 'value', {name})"
        return F.expr(f"max({f'IF({name} IS NULL, NULL, {value})' if when else value}) AS __{name}")

    return changes.groupBy(*by).agg(
        *[told(n) for n in _LATEST], *[told(n, "kept") for n in _KEPT],
        F.max("ts").alias("__updated_at"))


def merge(folds: DataFrame, *by: str) -> DataFrame:
    return folds.groupBy(*by).agg(
        *[F.max(f"__{n}").alias(f"__{n}") for n in (*_LATEST, *_KEPT, "updated_at")])


def _bucket(column: str, buckets: int) -> str:
    return f"CAST(pmod(xxhash64({column}), {buckets}) AS INT)"


def _stored(spark, path: str, batch_id: int, schema: str, keys: DataFrame, on: str) -> DataFrame:
    """Rows of all batches so far whose ``on`` is among ``keys``, out of the buckets of these."""
    places = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most the buckets
    table = spark.read.schema(f"{schema}, batch long, bucket int").parquet(path)
    return table.where((F.col("batch") <= batch_id) & F.col("bucket").isin(places)).drop(
        "batch", "bucket").join(keys.select(on), on, "left_semi")


def _keep(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write by bucket: a file or a few for each, not one of each task."""
    append_batch(rows.hint("rebalance", "bucket"), path, batch_id, "bucket")


def write_subscriptions(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep the tables of ``path`` up to date with a stream of billing events."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    pair_schema = "org_id string, customer string"
    held_schema = f"{pair_schema}, ts timestamp, event_id " \
        + events.schema["event_id"].dataType.simpleString()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        news = materialize(accounts.relevant_events(batch).where(accounts._WRITES_STATE), "news")
        named = news.withColumn("org", F.expr(_NAMED))
        append_batch(fold(accounts._changes(named), "org_id"), f"{path}/named", batch_id)
        _keep(select(news.where(f"customer IS NOT NULL AND {_NAMED} IS NULL"),
                     {"bucket": _bucket("customer", buckets)}), f"{path}/events", batch_id)
        facts = named.where("org IS NOT NULL AND customer IS NOT NULL").selectExpr(
            "org AS org_id", "customer", "ts", "event_id", f"{_bucket('org', buckets)} AS bucket")
        _keep(facts, f"{path}/held", batch_id)
        pairs = materialize(facts.select("org_id", "customer", "bucket").distinct(), "pairs")
        _keep(pairs, f"{path}/holdings", batch_id)
        _keep(select(pairs, {"bucket": _bucket("customer", buckets)}), f"{path}/holders", batch_id)
        append_batch(_resolved(spark, news, pairs, batch_id), f"{path}/resolved", batch_id)

    def _resolved(spark, news, pairs, batch_id):
        with_news = pairs.select("org_id", "bucket").distinct()
        others = _stored(spark, f"{path}/holdings", batch_id, pair_schema, with_news, "org_id")
        touched = materialize(
            news.where("customer IS NOT NULL").select("customer").unionByName(
                others.select("customer")).distinct().selectExpr(
                "customer", f"{_bucket('customer', buckets)} AS bucket"), "touched")
        theirs = _stored(spark, f"{path}/events", batch_id, schema, touched, "customer")
        owners = _stored(
            spark, f"{path}/holders", batch_id, pair_schema, touched, "customer").select(
            "org_id").distinct()
        owners = materialize(select(owners, {"bucket": _bucket("org_id", buckets)}), "owners")
        held = _stored(spark, f"{path}/held", batch_id, held_schema, owners, "org_id")
        facts = held.withColumns({
            "type": F.lit(fixed.CHECKOUT_EVENT), "mode": F.lit("subscription")})
        every = theirs.unionByName(facts, allowMissingColumns=True)
        found = accounts.with_organisation(every).where(f"{_NAMED} IS NULL")
        changes = accounts._changes(found)
        folds = fold(changes.withColumn("__buyer", F.col("customer")), "__buyer", "org_id")
        return touched.selectExpr("customer AS __buyer").join(folds, "__buyer", "left")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """The state of every organisation, as ``accounts.subscription_state`` gives it."""
    resolved = spark.read.parquet(f"{path}/resolved")
    last = resolved.groupBy("__buyer").agg(F.max("batch").alias("batch"))
    current = resolved.join(last, ["__buyer", "batch"]).where("org_id IS NOT NULL")
    folds = spark.read.parquet(f"{path}/named").drop("batch").unionByName(
        current.drop("__buyer", "batch"))
    return merge(folds, "org_id").selectExpr(
        "org_id", *[f"__{n}.value AS {n}" for n in ("plan", "status", *_KEPT)],
        "__cancel_at_period_end.value AS cancel_at_period_end", "__updated_at AS updated_at")
