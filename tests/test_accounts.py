import datetime as dt
import random

from pyspark.sql import functions as F

from tersa.operators import accounts

T0 = dt.datetime(2024, 1, 1)
FLAT = ("event_id string, type string, ts timestamp, org_id string, plan_meta string, trial string, "
        "client_reference_id string, customer string, object_id string, mode string, "
        "subscription string, status string, unit_amount long, period_end timestamp, "
        "cancel_at_period_end boolean, attempt_count int")
SUB = "customer.subscription.updated"


def event(i, kind=SUB, **kw):
    base = dict.fromkeys([c.split()[0] for c in FLAT.split(", ")])
    base.update(event_id=f"e{i}", type=kind, ts=T0 + dt.timedelta(minutes=40 * i), status="active")
    base.update(kw)
    return tuple(base.values())


def state(spark, *events):
    out = accounts.subscription_state(spark.createDataFrame(list(events), FLAT))
    return {r.org_id: r for r in out.collect()}


def test_fold(spark):
    got = state(
        spark,
        event(1, "checkout.session.completed", org_id="o1", customer="c1", mode="subscription",
              plan_meta="growth", trial="1", subscription="s1"),
        event(2, customer="c1", object_id="s2", unit_amount=39900, period_end=T0),  # by customer
        event(3, "invoice.payment_failed", customer="c1", object_id="i1"),
        event(3, "invoice.payment_failed", customer="c1", object_id="i1"),
        event(4, org_id="o2", plan_meta="starter", status="canceled", object_id="s3"),
        event(5, org_id="o3", unit_amount=1234, object_id="s4"),
        event(6, customer="unknown", plan_meta="scale"),
        event(7, "charge.refunded", org_id="o9", plan_meta="scale"),
        event(8, "checkout.session.completed", org_id="o4", mode="payment", plan_meta="scale"),
        event(9, client_reference_id="o5", plan_meta="scale", object_id="s5", customer="c5"),
        event(10, "customer.subscription.deleted", client_reference_id="o5", object_id=None,
              status="past_due", unit_amount=2900),
    )
    assert set(got) == {"o1", "o2", "o3", "o5"}
    o1 = got["o1"]
    assert (o1.plan, o1.status, o1.customer, o1.subscription) == ("scale", "active", "c1", "s2")
    assert o1.period_end == T0
    assert (got["o2"].plan, got["o2"].status) == ("free", "canceled")
    assert got["o3"].plan == "free"
    assert (got["o5"].plan, got["o5"].customer, got["o5"].subscription) == ("starter", "c5", "s5")


def test_customer_belongs_only_while_held(spark):
    events = [
        event(1, org_id="o1", customer="c1", object_id="a"),
        event(2, org_id="o1", customer="c2", object_id="b"),
        event(3, customer="c1", plan_meta="scale"),  # no longer o1's customer
        event(4, customer="c2", plan_meta="growth"),
    ]
    early = event(0, customer="c1", plan_meta="scale")  # before any link exists
    df = spark.createDataFrame([*events, early], FLAT)
    for bucket in ("minute", "hour", "year"):
        got = {r.event_id: r.org for r in accounts.with_organisation(df, bucket).collect()}
        assert got == {"e0": None, "e1": "o1", "e2": "o1", "e3": None, "e4": "o1"}


def test_entitlement_and_plans(spark):
    cases = [("active", "free", False), ("canceled", "growth", False), ("active", "growth", True),
             ("trialing", "starter", True), ("past_due", "starter", True), ("active", "gone", False),
             (None, "growth", False)]
    df = spark.createDataFrame(cases, "status string, plan string, want boolean")
    assert df.where(f"{accounts.is_entitled('status', 'plan')} <> want").count() == 0
    assert accounts.plans_table(spark).count() == 4


def test_quota(spark):
    df = spark.createDataFrame(
        [("free", 1500, 400), ("free", 1500, 501), ("nope", 2000, 1), ("scale", 0, 5_000_000)],
        "plan string, rows_used long, rows_requested long")
    out = accounts.quota_decisions(df).collect()
    assert [r.allowed for r in out] == [True, False, False, True]
    assert out[1].reason == ("Este fichero tiene 501 filas y sólo te quedan 500 en el plan Free "
                             "este mes.")
    assert out[2].reason.startswith("Has consumido las 2,000 filas de tu plan Free")


def test_nested_events_and_audit(spark):
    ddl = ("event_id string, type string, ts timestamp, object struct<id:string,status:string,"
           "customer:string,mode:string,subscription:string,client_reference_id:string,"
           "current_period_end:bigint,cancel_at_period_end:boolean,metadata:map<string,string>,"
           "items:array<struct<unit_amount:bigint>>,attempt_count:int>")
    rows = [
        ("e1", SUB, T0, ("s", "active", "c", None, None, None, 1704067200, True,
                         {"org_id": "o"}, [(9900,)], None)),
        ("e2", "invoice.payment_failed", T0, ("i", None, None, None, None, None, None, None,
                                              {"org_id": "o"}, [], 3)),
    ]
    flat = accounts.flatten_billing(spark.createDataFrame(rows, ddl))
    row = accounts.subscription_state(flat).head()
    assert (row.org_id, row.plan, row.cancel_at_period_end, row.period_end) == ("o", "growth", True, T0)
    audit = {(r.action, r.target): r.metadata for r in accounts.billing_audit(flat).collect()}
    assert audit["billing.subscription_updated", None] == {"plan": "growth", "status": "active"}
    assert audit["billing.payment_failed", None] == {"invoice": "i", "attempt": "3"}
    assert ("billing.event", "e1") in audit and ("billing.event", "e2") in audit


def replay(rows):
    buckets, out = {}, {}
    for event_id, key, plan, at in sorted(rows, key=lambda r: (r[3], r[0])):
        limit = accounts.fixed.REQUESTS_PER_MINUTE.get(plan, 30)
        tokens, seen = buckets.get(key, (float(limit), at))
        tokens = min(float(limit), tokens + max(0.0, at - seen) * (limit / 60.0))
        if tokens >= 1:
            tokens -= 1
            out[event_id] = (True, int(tokens), 0)
        else:
            out[event_id] = (False, 0, max(1, int((1 - tokens) / (limit / 60.0)) + 1))
        buckets[key] = (tokens, at)
    return out


def test_request_limits(spark):
    rng = random.Random(2)
    rows, now = [], 0.0
    for i in range(3000):
        now += rng.choice([0.01, 0.2, 0.5, 2.0]) if i % 400 else 90.0
        key = rng.choice(["hot", "hot", "a", "b"])
        plan = {"hot": "public", "a": "signup", "b": "odd"}[key]
        rows.append((i, key, plan, round(now, 3)))
    df = spark.createDataFrame(rows, "event_id long, key string, plan string, at double").select(
        "event_id", "key", "plan", F.expr("timestamp_micros(CAST(round(at * 1e6) AS BIGINT)) AS ts"))
    got = {r.event_id: (r.allowed, r.remaining, r.retry_after)
           for r in accounts.over_limit_events(df).collect()}
    assert got == replay(rows)
    assert 0 < sum(not v[0] for v in got.values()) < 3000


def test_a_key_that_is_never_idle_is_cut(spark):
    rng, now, rows = random.Random(3), 0.0, []
    pace = 60 / accounts.fixed.REQUESTS_PER_MINUTE["public"]
    for i in range(3000):  # below the limit on the whole, with rushes, never idle for a minute
        now += pace * rng.choice([0.1, 0.9, 1.0, 1.4, 2.0, 2.5])
        rows.append((i, "hot", "public", round(now, 3)))
    rows += [(10_000 + i, "mixed", ("signup", "public")[i % 2], float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, key string, plan string, at double").select(
        "event_id", "key", "plan", F.expr("timestamp_micros(CAST(round(at * 1e6) AS BIGINT)) AS ts"))
    ready = df.selectExpr("event_id", "key", "ts", f"{accounts.requests_per_minute('plan')} AS limit",
                          "unix_micros(ts) / 1e6D AS at")
    cuts = {r.key: r.n for r in accounts.with_bursts(ready).groupBy("key").agg(
        F.countDistinct("burst").alias("n")).collect()}
    assert cuts["mixed"] == 1 and cuts["hot"] > 100
    assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in accounts.over_limit_events(
        df.where("key = 'hot'")).collect()} == replay(rows[:3000])


def test_runs(spark):
    runs = spark.createDataFrame(
        [(i, "o1" if i % 2 else "o2", T0 + dt.timedelta(days=i), 10, "free") for i in range(60)],
        "run_id long, org_id string, created_at timestamp, rows_in long, plan string")
    newest = accounts.recent_runs(runs, 3)
    assert sorted(r.run_id for r in newest.collect()) == [54, 55, 56, 57, 58, 59]
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    assert accounts.retained_runs(runs, "2024-03-01 00:00:00").count() == 7
    usage = accounts.monthly_usage(runs)
    left = accounts.usage_remaining(
        spark.createDataFrame([("o1", "free"), ("zz", "growth")], "org_id string, plan string"),
        usage, "2024-01-01")
    assert {r.org_id: (r.rows_used, r.rows_remaining) for r in left.collect()} == {
        "o1": (150, 1850), "zz": (0, 500_000)}


def test_subscriptions_of_a_shuffled_stream(spark, tmp_path):
    """Unnamed events belong to the holder of their time, however late that becomes known."""
    from tersa.plans import queries
    from tersa.streaming import subscriptions

    log = queries.billing(spark, "/root/testdata/sf0.001")
    want = sorted(accounts.subscription_state(log).collect())
    rows = log.where("event_id % 2 = 0").unionByName(log)  # many deliveries twice
    for n, files in enumerate((3, 2)):
        feed = queries._feed(spark, rows, queries._shuffled(F.lit(n), "event_id", "ts", files=files), files)
        place = str(tmp_path / f"s{n}")
        queries._run_sink(subscriptions.write_subscriptions(feed, place, place + "-log", buckets=4))
        got = subscriptions.read_subscriptions(spark, place)
        assert got.columns == accounts.subscription_state(log).columns
        assert sorted(got.collect()) == want
