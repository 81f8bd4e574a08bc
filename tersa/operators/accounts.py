"""Account tables: usage, quotas, subscriptions, runs, limits.

The plan catalogue has four fixed rows, so plan attributes are CASE expressions
and need no join. Hot organisations only meet partial aggregates, ranking
windows with a pushed-down limit, or windows cut by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import any_of, case, literal, lookup, quote, select
from ..functions.text import thousands
from ..session import materialize

_PLAN_FIELDS = ("plan", "plan_name", "price_cents", "monthly_rows", "api_access", "retention_days")
_PAID = tuple(p[0] for p in fixed.PLANS if p[2] > 0)


# --- plans -----------------------------------------------------------------

def plans_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.PLANS),
        "plan string, plan_name string, price_cents bigint, monthly_rows bigint, "
        "api_access boolean, retention_days int")


def plan_attribute(plan: str, attribute: str) -> str:
    """Attribute of a plan; an unknown plan degrades to the free one."""
    at = _PLAN_FIELDS.index(attribute)
    table = {row[0]: row[at] for row in fixed.PLANS[1:]}
    return lookup(f"lower(coalesce({plan}, ''))", table, literal(fixed.PLANS[0][at]))


def plan_from_amount(cents: str) -> str:
    """Paid plan with exactly this price, or null."""
    return lookup(cents, {row[2]: row[0] for row in fixed.PLANS if row[2] > 0})


def is_entitled(status: str, plan: str) -> str:
    return (
        f"coalesce({any_of(status, fixed.ENTITLED_STATUSES)} AND "
        f"{plan_attribute(plan, 'price_cents')} > 0, false)")


# --- usage and quotas ------------------------------------------------------

def monthly_usage(runs: DataFrame) -> DataFrame:
    """Rows processed and jobs per organisation and calendar month.

    ``runs``: org_id, created_at, rows_in. Also valid on a watermarked stream.
    """
    return runs.groupBy("org_id", F.trunc("created_at", "month").alias("period")).agg(
        F.sum("rows_in").cast("bigint").alias("rows_processed"),
        F.count("*").alias("jobs_run"))


def usage_remaining(orgs: DataFrame, usage: DataFrame, period: str) -> DataFrame:
    """Rows left in ``period`` (first day of a month) for every organisation.

    ``orgs``: org_id, plan. Organisations without runs have used nothing.
    """
    used = usage.where(f"period = DATE {quote(period)}").select("org_id", "rows_processed")
    counted = orgs.join(used, "org_id", "left").selectExpr(
        "org_id", f"{plan_attribute('plan', 'plan')} AS plan",
        "CAST(coalesce(rows_processed, 0) AS BIGINT) AS rows_used",
        f"CAST({plan_attribute('plan', 'monthly_rows')} AS BIGINT) AS rows_included")
    return select(counted, {"rows_remaining": "greatest(0, rows_included - rows_used)"})


def quota_decisions(requests: DataFrame) -> DataFrame:
    """Allow or refuse each request.

    ``requests``: org_id, plan, rows_used, rows_requested.
    """
    limit = f"CAST({plan_attribute('plan', 'monthly_rows')} AS BIGINT)"
    label = plan_attribute("plan", "plan_name")
    left = f"({limit} - rows_used)"
    spent = (
        f"concat('Has consumido las ', {thousands(limit, ',')}, ' filas de tu plan ', {label}, "
        "' este mes. El contador se reinicia el día 1.')")
    too_big = (
        f"concat('Este fichero tiene ', {thousands('rows_requested', ',')}, ' filas y sólo te "
        f"quedan ', {thousands(left, ',')}, ' en el plan ', {label}, ' este mes.')")
    return select(requests, {
        "allowed": f"rows_requested <= {left}",
        "reason": case(
            (f"rows_requested <= {left}", "''"), (f"{left} <= 0", spent), default=too_big),
    })


# --- billing events --------------------------------------------------------

def flatten_billing(events: DataFrame) -> DataFrame:
    """Nested billing events (``object`` struct) as the flat columns used below."""
    return events.selectExpr(
        "event_id", "type", "ts",
        "object.metadata['org_id'] AS org_id", "object.metadata['plan'] AS plan_meta",
        "object.metadata['trial'] AS trial", "object.client_reference_id",
        "object.customer AS customer", "object.id AS object_id", "object.mode AS mode",
        "object.subscription AS subscription", "object.status AS status",
        "try_element_at(object.items, 1).unit_amount AS unit_amount",
        "timestamp_seconds(object.current_period_end) AS period_end",
        "object.cancel_at_period_end AS cancel_at_period_end",
        "object.attempt_count AS attempt_count")


HANDLED_EVENTS = (fixed.CHECKOUT_EVENT, fixed.PAYMENT_FAILED_EVENT, *fixed.SUBSCRIPTION_EVENTS)


def relevant_events(events: DataFrame) -> DataFrame:
    """Event types that matter, each event id once (repeated deliveries drop out)."""
    return events.where(any_of("type", HANDLED_EVENTS)).dropDuplicates(["event_id"])


def last_before(
    df: DataFrame, key: str, value: str, into: str, order: tuple[str, str] = ("ts", "event_id"),
    bucket: str = "hour",
) -> DataFrame:
    """Last non-null ``value`` among strictly earlier rows of the same ``key``.

    Two levels, so a hot key is not one window: the last value per key and time
    bucket comes from a partial aggregate and is carried across the (few)
    buckets of the key; only rows of one bucket share a window.
    """
    by = ", ".join(order)
    rows = select(df, {"__bucket": f"date_trunc('{bucket}', {order[0]})"})
    buckets = rows.where(f"{key} IS NOT NULL").groupBy(key, "__bucket").agg(F.expr(
        f"max_by({value}, IF({value} IS NOT NULL, struct({by}), NULL)) AS __last"))
    carried = buckets.selectExpr(
        key, "__bucket",
        f"last(__last, true) OVER (PARTITION BY {key} ORDER BY __bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __carried")
    joined = rows.join(carried, [key, "__bucket"], "left")
    inside = (
        f"last({value}, true) OVER (PARTITION BY {key}, __bucket ORDER BY {by} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    # Rows without a key have nothing before them: spread instead of one window.
    alone = f"IF({key} IS NULL, NULL, coalesce({inside}, __carried))"
    return select(joined, {into: alone}, keep=[c for c in joined.columns if not (
        c in ("__bucket", "__carried"))])


_WRITES_STATE = (
    f"((type = '{fixed.CHECKOUT_EVENT}' AND coalesce(mode, '') = 'subscription') "
    f"OR {any_of('type', fixed.SUBSCRIPTION_EVENTS)})")


def with_organisation(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Adds ``org``: metadata, then client reference, then the customer's owner.

    The owner is the organisation whose stored customer it was when the event
    happened: a link counts only for later events, and only while the
    organisation has not been given another customer. The e-mail never counts.
    """
    given = events.columns
    alone = "concat('\\u0000', event_id)"  # a key of its own for what cannot be looked up
    told = select(events, {
        "__named": "coalesce(nullif(org_id, ''), nullif(client_reference_id, ''))",
        "__buyer": f"coalesce(customer, {alone})"})
    told = materialize(select(told, {"__owner": f"IF({_WRITES_STATE}, __named, NULL)"}), "told")
    found = last_before(told, "__buyer", "__owner", "__candidate", bucket=bucket)
    # Is the customer still the one the candidate organisation holds?
    held = materialize(select(found, {
        "__who": f"coalesce(__named, __candidate, {alone})",
        "__holds": "IF(__owner IS NOT NULL, customer, NULL)"}), "held")
    checked = last_before(held, "__who", "__holds", "__current", bucket=bucket)
    return select(checked, {
        "org": "coalesce(__named, IF(__current = customer, __candidate, NULL))"}, keep=given)


def _changes(resolved: DataFrame) -> DataFrame:
    valid = f"IF({any_of('plan_meta', _PAID)}, plan_meta, NULL)"
    status = "coalesce(status, 'inactive')"
    sale = f"type = '{fixed.CHECKOUT_EVENT}'"
    by_money = f"coalesce({valid}, {plan_from_amount('unit_amount')}, 'free')"
    return resolved.where(f"{_WRITES_STATE} AND org IS NOT NULL").selectExpr(
        "org AS org_id", "ts", "event_id", "type", "plan_meta",
        case((sale, f"coalesce({valid}, 'free')"),
             (any_of(status, fixed.ENTITLED_STATUSES), by_money), default="'free'") + " AS plan",
        case((sale, "IF(trial = '1', 'trialing', 'active')"), default=status) + " AS status",
        "customer",
        f"IF({sale}, subscription, object_id) AS subscription",
        f"IF({sale}, NULL, period_end) AS period_end",
        f"NOT ({sale}) AND coalesce(cancel_at_period_end, false) AS cancel_at_period_end")


def subscription_changes(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """What each relevant event writes to the subscription of its organisation."""
    return _changes(with_organisation(relevant_events(events), bucket)).drop("type", "plan_meta")


def fold_subscriptions(changes: DataFrame) -> DataFrame:
    """Latest state per organisation, in event time.

    Plan, status and the cancel mark are overwritten; customer, subscription and
    period end keep their last known value. All are mergeable aggregates.
    """
    def latest(name):
        return F.expr(f"max_by({name}, struct(ts, event_id)) AS {name}")

    def kept(name):
        return F.expr(f"max_by({name}, IF({name} IS NULL, NULL, struct(ts, event_id))) AS {name}")

    return changes.groupBy("org_id").agg(
        latest("plan"), latest("status"), kept("customer"), kept("subscription"),
        kept("period_end"), latest("cancel_at_period_end"), F.expr("max(ts) AS updated_at"))


def subscription_state(events: DataFrame, bucket: str = "hour") -> DataFrame:
    return fold_subscriptions(subscription_changes(events, bucket))


def entitled_orgs(state: DataFrame) -> DataFrame:
    return state.where(is_entitled("status", "plan"))


def billing_audit(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Audit rows of billing events, ready to append.

    Columns: org_id, actor_id, action, target, metadata, created_at.
    """
    resolved = materialize(with_organisation(relevant_events(events), bucket), "resolved")
    nothing = "CAST(NULL AS STRING)"

    def lines(df, org, action, target, metadata):
        return df.selectExpr(
            f"{org} AS org_id", f"{nothing} AS actor_id", f"{action} AS action",
            f"{target} AS target", f"{metadata} AS metadata", "ts AS created_at")

    sale = f"type = '{fixed.CHECKOUT_EVENT}'"
    changed = lines(
        _changes(resolved), "org_id",
        f"IF({sale}, 'billing.checkout_completed', 'billing.subscription_updated')", nothing,
        f"IF({sale}, map('plan', coalesce(nullif(plan_meta, ''), 'free')), "
        "map('plan', plan, 'status', status))")
    failed = lines(
        resolved.where(f"type = '{fixed.PAYMENT_FAILED_EVENT}' AND org IS NOT NULL"), "org",
        "'billing.payment_failed'", nothing,
        "map('invoice', object_id, 'attempt', CAST(attempt_count AS STRING))")
    seen = lines(
        resolved, nothing, "'billing.event'", "CAST(event_id AS STRING)",
        "CAST(map() AS MAP<STRING,STRING>)")
    return changed.unionByName(failed).unionByName(seen)


# --- runs ------------------------------------------------------------------

def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` runs of every organisation.

    Spark trims each organisation to ``n`` before the shuffle (window group limit).
    """
    newest = Window.partitionBy("org_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("position", F.row_number().over(newest)).where(f"position <= {n}")


def for_organisation(df: DataFrame, org_id: str) -> DataFrame:
    """One tenant's rows; prunes directories on a table laid out by ``org_id``."""
    return df.where(f"org_id = {quote(org_id)}")


def retained_runs(runs: DataFrame, as_of: str) -> DataFrame:
    """Runs still inside the retention of their plan. ``runs`` carries ``plan``."""
    days = plan_attribute("plan", "retention_days")
    return runs.where(
        f"created_at >= TIMESTAMP {quote(as_of)} - make_interval(0, 0, 0, {days})")


# --- request limits --------------------------------------------------------

BREAK_SECONDS = 61  # any bucket is full after sixty seconds without a request


def requests_per_minute(plan: str) -> str:
    return lookup(plan, fixed.REQUESTS_PER_MINUTE, literal(fixed.REQUESTS_PER_MINUTE["public"]))


def with_bursts(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Adds ``burst``: how often the bucket of the key was surely full up to a request.

    ``start`` (key, tokens, seen): buckets that are not full at first. What is missing
    in one counts like requests before; burst 0 goes on from it. Its tokens and time
    come along as ``start_tokens`` and ``start_seen``.

    ``log``: key, ts, event_id, limit, at (seconds). A bucket is surely full
    before a request if it would be had every earlier request been accepted. With
    ``y = rate * at - requests before``, that holds where y is as high as never
    before for its key; a pause that fills any bucket is such a point too. What
    lies between full points is independent of the rest, so a key that is never
    idle is cut too, as long as it keeps its limit on the whole; only stretches
    over the limit without a break stay sequential. Keys whose limit changes
    are cut at pauses alone.

    Found in two levels, key and minute, then within the minute, so a hot key is
    not one window.
    """
    rows = materialize(select(log, {"minute": "date_trunc('minute', ts)"}), "requests")
    order = "PARTITION BY key, minute ORDER BY ts, event_id"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    placed = select(rows, {
        "place": f"row_number() OVER ({order}) - 1", "last_at": f"lag(at) OVER ({order})"})
    placed = materialize(select(placed, {"y": "limit / 60.0D * at - place"}), "placed")
    minutes = placed.groupBy("key", "minute").agg(
        F.count("*").alias("n"), F.max("y").alias("high"), F.max("at").alias("end"),
        F.min("limit").alias("low_limit"), F.max("limit").alias("high_limit"))
    across = f"OVER (PARTITION BY key ORDER BY minute {before})"
    carried = minutes.selectExpr(
        "key", "minute", f"coalesce(sum(n) {across}, 0) AS base", "high",
        f"max(end) {across} AS end_before", "low_limit",
        "min(low_limit) OVER (PARTITION BY key) = max(high_limit) OVER (PARTITION BY key) AS even")
    state = ["start_tokens", "start_seen"]
    if start is None:
        carried = select(carried, dict.fromkeys(state, "CAST(NULL AS DOUBLE)"))
    else:
        carried = carried.join(start.selectExpr(
            "key", "tokens AS start_tokens", "seen AS start_seen"), "key", "left")
    level = "low_limit / 60.0D * start_seen + greatest(1.0D, low_limit) - start_tokens"
    carried = carried.selectExpr(
        "key", "minute", "base", "even", *state, "coalesce(end_before, start_seen) AS end_before",
        f"greatest(max(high - base) {across}, {level}) AS high_before")
    known = select(placed.join(carried, ["key", "minute"]), {
        "pause": "at - coalesce(last_at, end_before)",
        "top": f"greatest(high_before, max(y - base) OVER ({order} {before}))"})
    # The margin keeps rounding from calling a bucket full that is not.
    full = (f"pause IS NULL OR pause >= {BREAK_SECONDS} "
            "OR (even AND y - base >= coalesce(top, double('-inf')) + 1e-6D)")
    kept = [*log.columns, *state]
    marked = materialize(select(known, {"full": f"IF({full}, 1, 0)"}, keep=[*kept, "minute"]),
                         "marked")
    counted = marked.groupBy("key", "minute").agg(F.sum("full").alias("n")).selectExpr(
        "key", "minute", f"coalesce(sum(n) {across}, 0) AS earlier")
    return select(marked.join(counted, ["key", "minute"]), {
        "burst": f"earlier + sum(full) OVER ({order} ROWS UNBOUNDED PRECEDING)"}, keep=kept)


def take_token(tokens: float | None, seen: float, at: float, limit: int):
    """One request against a bucket: its new tokens, and what the caller is told.

    ``tokens`` is None for a bucket that is full. Returns tokens, allowed,
    remaining, retry after.
    """
    capacity, rate = max(1.0, float(limit)), limit / 60.0
    tokens = capacity if tokens is None else min(capacity, tokens + max(0.0, at - seen) * rate)
    if tokens >= 1.0:
        return tokens - 1.0, True, int(tokens - 1.0), 0
    return tokens, False, 0, max(1, int((1.0 - tokens) / rate) + 1)


def replayed_requests(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Every request with its answer, its time ``at`` and the ``tokens`` it leaves.

    ``start``: buckets that earlier requests have left, see ``with_bursts``. Every
    burst is replayed on its own; rows stream through sorted, so no burst is held in
    memory.
    """
    import pandas as pd

    ready = log.selectExpr(
        "event_id", "key", "ts", f"{requests_per_minute('plan')} AS limit",
        "unix_micros(ts) / 1e6D AS at")
    ordered = with_bursts(ready, start).repartition("key", "burst").sortWithinPartitions(
        "key", "burst", "ts", "event_id")

    def replay(batches):
        who, tokens, seen = None, None, 0.0
        for batch in batches:
            told = []
            for key, burst, at, limit, left, last in zip(
                    batch.key, batch.burst, batch["at"], batch.limit, batch.start_tokens,
                    batch.start_seen):
                if (key, burst) != who:
                    who, tokens, seen = (key, burst), *((left, last) if burst == 0 else (None, 0.0))
                tokens, *answer = take_token(tokens, seen, at, limit)
                seen = at
                told.append((*answer, tokens))
            allowed, remaining, retry, after = zip(*told, strict=True) if told else ((),) * 4
            yield pd.DataFrame({
                "event_id": batch.event_id, "key": batch.key, "ts": batch.ts,
                "allowed": list(allowed), "remaining": list(remaining), "retry_after": list(retry),
                "limit": batch.limit, "at": batch["at"], "tokens": list(after)})

    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInPandas(
        replay,
        f"event_id {types['event_id']}, key {types['key']}, ts timestamp, allowed boolean, "
        "remaining int, retry_after int, limit int, at double, tokens double")


def over_limit_events(log: DataFrame) -> DataFrame:
    """Replay a request log against per-key token buckets.

    ``log``: event_id, key, plan, ts. A bucket holds one minute's worth of
    requests, starts full and refills steadily. Adds allowed, remaining,
    retry_after and limit.
    """
    return replayed_requests(log).drop("at", "tokens")


def buckets_left(told: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``key, tokens, seen`` of the buckets that requests of ``replayed_requests`` leave.

    Buckets of ``before`` without a request come along, except those that must be full
    again by the time of the last request.
    """
    left = told.groupBy("key").agg(F.expr("max_by(struct(tokens, at), struct(ts, event_id)) AS s"))
    left = left.selectExpr("key", "s.tokens AS tokens", "s.at AS seen")
    if before is not None:
        left = left.unionByName(before.join(left, "key", "left_anti"))
    now = told.agg(F.max("at")).head()[0]
    return left if now is None else left.where(F.col("seen") + BREAK_SECONDS >= now)
