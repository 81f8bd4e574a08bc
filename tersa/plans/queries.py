"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, fixed, text
from ..functions.privacy import Pseudonymizer, mask_email
from ..functions.sql import quote
from ..operators import accounts, evaluate as ev, numeric, report, resolve, schema
from ..operators.grouped_outliers import grouped_outliers
from ..operators import worklist as wl
from ..operators.protection import mask, pseudonymise
from ..session import materialize, shared_folder
from ..sources.io import (
    append_batch, append_rows, read_ordered, read_records, read_table, spread, tasks_for,
    with_row_id, write_records, write_table)
from ..streaming import streams, subscriptions
from . import derived
from .clean import CleanOptions, clean

AS_OF = "1998-12-31 00:00:00"
PERIOD = "1998-03-01"
DEMO_KEY = "not-a-secret-key-used-for-checks-only-0123456789"
COST = report.CostAssumption(12.5, "Contabilidad")
FIELDS = derived.FIELDS


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark, sf_dir, query, *tables) -> DataFrame:
    return spark.sql(query, **{t: load(spark, sf_dir, t) for t in tables})


def crm(spark, sf_dir) -> DataFrame:
    people = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return spark.sql(derived.CRM, customer=spread(people))


def _customer_keys(spark, sf_dir) -> DataFrame:
    return spread(load(spark, sf_dir, "customer").select("c_custkey"))


def edges(spark, sf_dir) -> DataFrame:
    keys = _customer_keys(spark, sf_dir)
    return spark.sql(derived.EDGES, customer=keys).withColumn(
        "income", F.col("income").cast("double"))


def typed(spark, sf_dir) -> DataFrame:
    return spark.sql(derived.TYPED, customer=_customer_keys(spark, sf_dir))


def _timestamps(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


def billing(spark, sf_dir) -> DataFrame:
    """Billing log with every fiftieth event delivered twice."""
    log = _timestamps(
        _sql(spark, sf_dir, derived.BILLING, "events"), "ts", "period_end")
    return log.unionByName(log.where("event_id % 50 = 0"))


def runs(spark, sf_dir) -> DataFrame:
    return _timestamps(_sql(spark, sf_dir, derived.RUNS, "orders"), "created_at")


def _models(df):
    return numeric.fit_models(df, {"age": "age", "income": "income"})


def _evaluated(spark, sf_dir):
    df = crm(spark, sf_dir)
    return ev.evaluate(df, FIELDS, _models(df))


# --- D: one check over a whole column --------------------------------------

def _verdicts(kind, source=crm):
    def run(spark, sf_dir):
        out = checks.validate_column(source(spark, sf_dir), kind, kind)
        return out.select("row_id", "verdict.*")
    return run


def document_emails(spark, sf_dir):
    """E-mail check and mask over every address found in the documents."""
    pattern = quote(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+)")
    found = load(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"explode(regexp_extract_all(text, {pattern}, 1)) AS email")
    return checks.validate_column(found, "email", "email").selectExpr(
        "doc_id", "email", "verdict.rule", f"{mask_email('email')} AS masked")


# --- C: text ---------------------------------------------------------------

def _names(spark, sf_dir):
    """Every name in the given tables, with the number of its source."""
    people = crm(spark, sf_dir)
    return (
        people.selectExpr("1 AS src", "row_id AS id", "company AS t")
        .union(people.selectExpr("2", "row_id", "name"))
        .union(load(spark, sf_dir, "customer").selectExpr("3", "c_custkey", "c_name"))
        .union(load(spark, sf_dir, "supplier").selectExpr("4", "s_suppkey", "s_name")))


def _text(**columns):
    def run(spark, sf_dir):
        return _names(spark, sf_dir).selectExpr(
            "src", "id", *[f"{fn('t')} AS {n}" for n, fn in columns.items()])
    return run


def text_values(spark, sf_dir):
    """Numbers that reached the table as doubles, read back as identifiers."""
    orders = load(spark, sf_dir, "orders").selectExpr(
        "*", "CAST(o_custkey * 1000 + 600000000 AS DOUBLE) AS whole")
    double = orders.schema["whole"].dataType
    token = "IF(o_orderkey % 3 = 0, ' N/A ', concat('  ', o_orderpriority, ' '))"
    return orders.selectExpr(
        "o_orderkey", f"{text.text_value('whole', double)} AS whole_text",
        f"{text.text_value("concat(CAST(whole AS BIGINT), '.0')")} AS suffix_text",
        f"{text.text_value('o_totalprice', double)} AS price_text",
        f"{text.text_value(token)} AS token_text")


def rule_texts(spark, sf_dir):
    """Instruction, label and formatted count of every rule found in the table."""
    found = ev.findings_table(_evaluated(spark, sf_dir))
    return report.counts_by_rule(found).selectExpr(
        "rule", f"{text.action_for('rule')} AS action_text", f"{text.rule_label('rule')} AS label",
        f"{text.thousands('count * 1000')} AS thousands")


def formatted_ibans(spark, sf_dir):
    return crm(spark, sf_dir).selectExpr("row_id", f"{text.format_iban('iban')} AS iban")


# --- E: rows ---------------------------------------------------------------

def findings(spark, sf_dir):
    return ev.findings_table(_evaluated(spark, sf_dir)).withColumn(
        "confidence", F.round("confidence", 6))


def edge_findings(spark, sf_dir):
    df = edges(spark, sf_dir)
    return ev.findings_table(ev.evaluate(df, FIELDS, _models(df))).withColumn(
        "confidence", F.round("confidence", 6))


def quarantine_split(spark, sf_dir):
    """Both sides of the split, at each of the three thresholds."""
    table = ev.corrected(_evaluated(spark, sf_dir), FIELDS)
    out = None
    for bar in fixed.SEVERITIES:
        valid, quarantine = ev.split(table, bar)
        for side, frame in (("valid", valid), ("quarantine", quarantine)):
            part = frame.select(
                F.lit(bar).alias("quarantine_on"), F.lit(side).alias("side"), "row_id")
            out = part if out is None else out.unionByName(part)
    return out


def row_conservation(spark, sf_dir):
    table = ev.corrected(_evaluated(spark, sf_dir), FIELDS)
    valid, quarantine = ev.split(table)
    sides = valid.select(F.lit(1).alias("v")).unionByName(quarantine.select(F.lit(0).alias("v")))
    return sides.agg(
        F.count("*").alias("rows_in"), F.sum("v").alias("rows_valid"),
        F.sum(1 - F.col("v")).alias("rows_quarantined"))


def _values(apply):
    def run(spark, sf_dir):
        table = ev.corrected(_evaluated(spark, sf_dir), FIELDS, apply)
        return table.drop("__level").withColumn("income", F.round("income", 4))
    return run


def typed_values(spark, sf_dir):
    """Corrected output of identifiers that arrive as numbers: text, with what Excel ate."""
    df, fields = typed(spark, sf_dir), {"phone": "phone", "postal_code": "postal_code"}
    return ev.corrected(ev.evaluate(df, fields), fields).select("row_id", *fields)


def quality_gate(spark, sf_dir):
    return ev.any_quarantined(_evaluated(spark, sf_dir))


# --- F: numbers ------------------------------------------------------------

_NUMBERS = (
    ("customer", "c_acctbal"), ("orders", "o_totalprice"), ("lineitem", "l_extendedprice"),
    ("lineitem", "l_discount"), ("events", "value"),
)


def outlier_models(spark, sf_dir):
    models = {}
    for table in dict.fromkeys(t for t, _ in _NUMBERS):
        models.update(numeric.fit_models(
            load(spark, sf_dir, table), {c: c for t, c in _NUMBERS if t == table}))
    people = crm(spark, sf_dir)
    models.update(_models(people))
    out = numeric.models_table(spark, models)
    return out.select(
        "field", "n_fitted", "fallback",
        *[F.round(c, 6).alias(c) for c in ("median", "mad", "scale", "low", "high")])


def outlier_fallbacks(spark, sf_dir):
    """Models of constant, tied, empty and worded columns."""
    names = ("fixed_value", "tied", "nothing", "worded")
    models = numeric.fit_models(typed(spark, sf_dir), {n: n for n in names})
    return numeric.models_table(spark, models).select(
        "field", "n_fitted", "fallback",
        *[F.round(c, 6).alias(c) for c in ("median", "mad", "scale", "low", "high")])


def _flags(table, key, column):
    def run(spark, sf_dir):
        out = numeric.mad_outliers(load(spark, sf_dir, table), column)
        return out.select(*key, F.round("score", 6).alias("score"), "is_outlier")
    return run


def domain_flags(spark, sf_dir):
    people = crm(spark, sf_dir)
    return people.selectExpr(
        "row_id", f"{numeric.domain_message('age', 'age')} AS age_message",
        f"{numeric.domain_message('income', 'income')} AS income_message")


# --- G: duplicates ---------------------------------------------------------

def exact_key_links(spark, sf_dir):
    rows = resolve.key_rows(crm(spark, sf_dir), {
        f: f for f in fixed.KEY_CONFIDENCE})
    buckets = resolve.materialize(resolve.key_buckets(rows).where("n > 1"), "buckets")
    return resolve.star_links(rows, buckets)


def block_sizes(spark, sf_dir):
    rows = resolve.key_rows(crm(spark, sf_dir), {"company": "company", "postal_code": "postal_code"})
    return resolve.block_sizes(resolve.key_buckets(rows))


def name_keys(spark, sf_dir):
    return resolve.with_name_key(crm(spark, sf_dir), FIELDS).selectExpr(
        "row_id", "__block AS block", "__key AS key")


def candidate_pairs(spark, sf_dir):
    names = _sql(spark, sf_dir, derived.NAMES, "part")
    fields = {"company": "company", "postal_code": "postal_code"}
    return resolve.name_pairs(names, fields).select(
        "block", "key_a", "key_b", F.round("score", 6).alias("score"))


def _exact(spark, sf_dir):
    return resolve.exact_duplicates(crm(spark, sf_dir), FIELDS)


def duplicate_groups_exact(spark, sf_dir):
    return _exact(spark, sf_dir).groups.drop("group_id")


def duplicate_members_exact(spark, sf_dir):
    return _exact(spark, sf_dir).members


def _full(spark, sf_dir):
    return resolve.find_duplicates(crm(spark, sf_dir), FIELDS)


def duplicate_groups_full(spark, sf_dir):
    return _full(spark, sf_dir).groups.drop("group_id")


def duplicate_rows_nested(spark, sf_dir):
    return resolve.nested_groups(_full(spark, sf_dir)).withColumn(
        "duplicate_rows", F.array_join(F.col("duplicate_rows").cast("array<string>"), ","))


def duplicate_findings(spark, sf_dir):
    return resolve.duplicate_findings(_full(spark, sf_dir))


def similar_name_groups(spark, sf_dir):
    names = _sql(spark, sf_dir, derived.NAMES, "part")
    return resolve.find_duplicates(
        names, {"company": "company", "postal_code": "postal_code"}).members


def _similar_groups(field):
    def run(spark, sf_dir):
        names = _sql(spark, sf_dir, derived.NAMES, "part")
        found = resolve.find_duplicates(names, {field: "company", "postal_code": "postal_code"})
        return found.groups.drop("group_id").withColumn("confidence", F.round("confidence", 6))
    return run


# --- H: protection ---------------------------------------------------------

def pseudonymised(spark, sf_dir):
    out = pseudonymise(crm(spark, sf_dir), FIELDS, Pseudonymizer(DEMO_KEY, "org_1"))
    return out.select("row_id", "name", "company", "email", "phone", "tax_id", "iban")


def masked(spark, sf_dir):
    return mask(crm(spark, sf_dir), FIELDS).select("row_id", "email", "phone", "tax_id", "iban")


# --- I: report and worklist ------------------------------------------------

def _crm_run(spark, sf_dir, **options):
    return clean(crm(spark, sf_dir), CleanOptions(row_id="row_id", column_overrides=FIELDS, **options))


def counts_by_rule(spark, sf_dir):
    return report.counts_by_rule(ev.findings_table(_evaluated(spark, sf_dir)))


def counts_by_severity(spark, sf_dir):
    return report.counts_by_severity(ev.findings_table(_evaluated(spark, sf_dir)))


def top_rules(spark, sf_dir):
    return report.top_rules(ev.findings_table(_evaluated(spark, sf_dir)), 12)


def cost_total(spark, sf_dir):
    return report.cost_total(ev.findings_table(_evaluated(spark, sf_dir)), COST)


def audit_report(spark, sf_dir):
    """The report of a whole run, duplicates included (maps as sorted text)."""
    return _flat_report(_crm_run(spark, sf_dir).report())


def _flat_report(row):
    def flat(name):
        return F.array_join(F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string")))), ";").alias(name)

    return row.select(
        "engine_version", "rows_in", "rows_valid", "rows_quarantined", "duplicate_groups",
        "duplicate_rows", flat("columns_detected"),
        F.array_join("unmapped_columns", ";").alias("unmapped_columns"),
        flat("counts_by_rule"), flat("counts_by_severity"))


def report_json(spark, sf_dir):
    """The report of a run without duplicates, written as JSON and read back."""
    row, place = _crm_run(spark, sf_dir, detect_duplicates=False).report(), _place(spark, "report")
    write_records(row, place)
    return _flat_report(read_records(spark, place, row.schema))


def report_sections(spark, sf_dir):
    row = _crm_run(spark, sf_dir, detect_duplicates=False).report()
    return report.report_sections(row, COST).where("label <> 'Tiempo de proceso' or label is null")


def worklist(spark, sf_dir):
    """Full list, duplicates included."""
    return _worklist_names(_crm_run(spark, sf_dir).worklist(include_info=True))


_WORKLIST_ALIASES = (
    "line", "client", "document", "field", "current_value", "problem", "suggestion",
    "instruction", "severity", "confidence", "rule",
)


def _worklist_names(df, *more):
    return df.select(*more, *[
        F.col(f"`{c}`").alias(a)
        for c, a in zip(fixed.WORKLIST_COLUMNS, _WORKLIST_ALIASES, strict=True)])


def worklist_csv(spark, sf_dir):
    """The list as CSV files; read by name they keep its order."""
    lines = wl.build_worklist(_evaluated(spark, sf_dir), FIELDS, include_info=True)
    place = _place(spark, "worklist")
    write_table(lines, place)
    return _worklist_names(read_ordered(spark, place), "place").na.fill("").withColumns({
        "line": F.col("line").cast("long"), "confidence": F.col("confidence").cast("double")})


def worklist_summary(spark, sf_dir):
    lines = wl.build_worklist(_evaluated(spark, sf_dir), FIELDS, ordered=False)
    return wl.worklist_summary(lines)


# --- J: account tables -----------------------------------------------------

def monthly_usage(spark, sf_dir):
    return accounts.monthly_usage(runs(spark, sf_dir))


def usage_remaining(spark, sf_dir):
    log = runs(spark, sf_dir)
    return accounts.usage_remaining(
        log.groupBy("org_id").agg(F.max("plan").alias("plan")), accounts.monthly_usage(log), PERIOD)


def quota_decisions(spark, sf_dir):
    """Would each run have fitted what its organisation used in one month?"""
    log = runs(spark, sf_dir)
    used = accounts.monthly_usage(log).where(F.col("period") == F.lit(PERIOD).cast("date")).select(
        "org_id", F.col("rows_processed").alias("rows_used"))
    asked = log.join(used, "org_id", "left").select(
        "run_id", "plan", F.coalesce("rows_used", F.lit(0)).alias("rows_used"), (F.col("rows_in") * 7).alias("rows_requested"))
    return accounts.quota_decisions(asked)


def plan_from_amount(spark, sf_dir):
    return billing(spark, sf_dir).selectExpr(
        "event_id", "unit_amount", f"{accounts.plan_from_amount('unit_amount')} AS plan",
        f"{accounts.plan_attribute('plan_meta', 'monthly_rows')} AS monthly_rows")


def relevant_billing_events(spark, sf_dir):
    return accounts.relevant_events(billing(spark, sf_dir)).select("event_id", "type", "status")


def billing_organisations(spark, sf_dir):
    return accounts.with_organisation(
        accounts.relevant_events(billing(spark, sf_dir))).select("event_id", "type", "org")


def _plain(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def subscription_state(spark, sf_dir):
    return _plain(accounts.subscription_state(billing(spark, sf_dir)), "period_end", "updated_at")


def entitled_orgs(spark, sf_dir):
    return accounts.entitled_orgs(accounts.subscription_state(billing(spark, sf_dir))).select(
        "org_id", "plan", "status")


def billing_audit(spark, sf_dir):
    out = accounts.billing_audit(billing(spark, sf_dir))
    return _plain(out, "created_at").withColumn("metadata", F.array_join(F.array_sort(
        F.transform(F.map_entries("metadata"), lambda e: F.concat(
            e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))), ";")).drop("actor_id")


def recent_runs(spark, sf_dir):
    return _plain(accounts.recent_runs(runs(spark, sf_dir), 20), "created_at")


def retained_runs(spark, sf_dir):
    return _plain(accounts.retained_runs(runs(spark, sf_dir), AS_OF), "created_at")


def tenant_runs(spark, sf_dir):
    """One organisation of a table laid out by organisation: its folders alone are read."""
    log, place = runs(spark, sf_dir), _place(spark, "runs")
    append_rows(log, place, "org_id")
    stored = spark.read.schema(log.schema).parquet(place)
    return _plain(accounts.for_organisation(stored, "org_7"), "created_at").select(log.columns)


def _request_log(spark, sf_dir):
    """The event log as requests: a month squeezed into twenty minutes, hot keys."""
    return load(spark, sf_dir, "events").selectExpr(
        "event_id",
        "timestamp_micros((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) DIV 2160) AS ts",
        "IF(user_id % 3 = 0, 'hot', concat('key_', user_id % 20)) AS key",
        "CASE WHEN user_id % 3 = 0 THEN 'scale' WHEN user_id % 2 = 0 THEN 'signup' "
        "ELSE 'public' END AS plan")


def over_limit_events(spark, sf_dir):
    return accounts.over_limit_events(_request_log(spark, sf_dir)).select(
        "event_id", "key", "allowed", "remaining", "retry_after", "limit")


# --- A, B: identity, mapping ------------------------------------

def row_identity(spark, sf_dir):
    return with_row_id(load(spark, sf_dir, "customer")).select("row_id", "c_custkey", "c_name")


def _place(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark, sf_dir):
    """All values come back as the text they were, quotes, commas and leading zeros included."""
    rows = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "lpad(CAST(c_custkey AS STRING), 8, '0') AS code",
        "concat(c_name, ', \"', c_mktsegment, '\"') AS note", "IF(c_custkey % 3 = 0, NULL, c_name) AS some")
    place = _place(spark, "csv")
    write_table(rows, place)
    return read_table(spark, place)


def records_round_trip(spark, sf_dir):
    """JSON rows; NaN comes back as absent."""
    rows = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS note",
        "IF(c_custkey % 4 = 0, double('NaN'), CAST(c_custkey AS DOUBLE) / 8) AS share")
    place = _place(spark, "records")
    write_records(rows, place)
    return read_records(spark, place, rows.schema)


def run_log_append(spark, sf_dir):
    """Two appends to a log laid out by organisation."""
    log, place = runs(spark, sf_dir).select("org_id", "run_id", "rows_in"), _place(spark, "log")
    append_rows(log, place, "org_id")
    append_rows(log.where("run_id % 2 = 0"), place, "org_id")
    return spark.read.parquet(place).groupBy("org_id").agg(
        F.count("*").alias("entries"), F.sum("rows_in").alias("rows_in"))


def run_log_retried(spark, sf_dir):
    """Two batches, the first of them twice, as a job that was tried again: it counts once."""
    log, place = runs(spark, sf_dir).select("org_id", "run_id", "rows_in"), _place(spark, "log")
    for batch in ("first", "second", "first"):
        append_batch(log, place, batch, "org_id")
    return spark.read.parquet(place).groupBy("org_id").agg(
        F.count("*").alias("entries"), F.sum("rows_in").alias("rows_in"))


def row_identity_filtered(spark, sf_dir):
    """Rows of a table that sits in any partition but the first."""
    base = load(spark, sf_dir, "customer")
    empty = base.where("c_custkey < 0").coalesce(1)
    return with_row_id(empty.unionByName(base)).select("row_id", "c_custkey")


_SPANISH = {
    "row_id": "Nº Cliente", "company": "Razón Social", "name": "Persona de contacto",
    "tax_id": "campo1", "email": "campo2", "phone": "Tlf", "iban": "Cuenta bancaria",
    "postal_code": "CP", "age": "Edad", "income": "Facturación anual",
}


def schema_matches(spark, sf_dir):
    headed = crm(spark, sf_dir).select(*[F.col(c).alias(h) for c, h in _SPANISH.items()])
    found, unmapped = schema.detect_schema(headed)
    rest = [schema.Match(c, "", 0.0, "unmapped") for c in unmapped]
    return schema.matches_table(spark, found + rest).withColumn(
        "confidence", F.round("confidence", 4))


# --- L: streams ------------------------------------------------------------

def _stream(spark, sf_dir, name):
    """The whole table as a file stream (a glob, since a source wants a folder)."""
    path = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(load(spark, sf_dir, name).schema).parquet(path)


def _drain(stream):
    """Run a stream over all it can read now and return what it wrote."""
    import uuid

    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/out")
        .option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def stream_verdicts(spark, sf_dir):
    """Findings of a stream of customers equal those of the batch."""
    rows = load(spark, sf_dir, "customer").count()
    people = spark.sql(derived.CRM, customer=spread(_stream(spark, sf_dir, "customer"), rows))
    cleaner = streams.StreamCleaner(FIELDS, _models(crm(spark, sf_dir)))
    found = cleaner.findings(people).select("row_id", "column", "rule", "severity", "proposed")
    return _drain(found)


def stream_events(spark, sf_dir):
    """Billing events of a stream, each delivery twice, kept once."""
    log = _timestamps(spark.sql(derived.BILLING, events=_stream(spark, sf_dir, "events")),
                      "ts", "period_end")
    twice = log.unionByName(log)
    return _drain(streams.relevant_events_stream(twice).select("event_id", "type", "status"))


def _feed(spark, df, by, files=5):
    """``df`` as a stream of ``files`` micro-batches: of all rows with the same ``by``, in turn.

    Each micro-batch is as many files as the largest one is worth tasks.
    """
    place, rows = _place(spark, "feed"), materialize(df.withColumn("__turn", by), "turns")
    sizes = dict(rows.where(F.col("__turn").between(0, files - 1)).groupBy(
        "__turn").count().collect())  # a row for each turn
    parts = tasks_for(spark, max(sizes.values(), default=0))
    for turn in range(files):  # one after the other, since a file source goes by age
        one = rows.where(F.col("__turn") == turn).drop("__turn")
        (one.repartition(parts) if parts > 1 else one.coalesce(1)).write.mode(
            "append").parquet(place)
        # The source counts files, and an empty part has written none.
        there = len(spark.read.schema(df.schema).parquet(place).inputFiles())
        for _ in range((turn + 1) * parts - there):
            spark.createDataFrame([], df.schema).write.mode("append").parquet(place)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(place)


def _shuffled(*keys, files=5):
    return F.pmod(F.xxhash64(*keys), F.lit(files)).cast("int")


def _run_sink(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_split(spark, sf_dir):
    """Both sides of a stream, valid rows masked, each micro-batch evaluated once."""
    people, place = crm(spark, sf_dir), _place(spark, "split")
    cleaner = streams.StreamCleaner(FIELDS, _models(people), mask_output=True)
    _run_sink(streams.write_split(_feed(spark, people, _shuffled("row_id")), cleaner, f"{place}/out",
                                  f"{place}/log"))
    return spark.read.parquet(f"{place}/out").drop("batch").withColumn(
        "income", F.round("income", 4))


def stream_windows(spark, sf_dir):
    """Findings by rule and hour; rows come out of order, some after their window has closed."""
    people, place = crm(spark, sf_dir).selectExpr(
        "*", "timestamp_seconds(1704067200 + row_id * 120) AS ts"), _place(spark, "windows")
    cleaner = streams.StreamCleaner(FIELDS, _models(people))
    found = cleaner.findings(_feed(spark, people, _shuffled("row_id")), "ts")
    _run_sink(streams.write_windows(found, f"{place}/out", f"{place}/log"))
    streams.close_windows(spark, f"{place}/out")
    both = streams.read_windows(spark, f"{place}/out").unionByName(
        streams.read_windows(spark, f"{place}/out", "late"))
    return both.groupBy(F.unix_seconds("window_start").alias("window_start"), "rule").agg(
        F.sum("count").alias("count"))


def stream_usage(spark, sf_dir):
    """Monthly usage kept up to date by a stream of runs in no order."""
    log, place = runs(spark, sf_dir), _place(spark, "usage")
    _run_sink(streams.write_usage(_feed(spark, log, _shuffled("run_id")), f"{place}/out",
                                  f"{place}/log", lateness="3650 days"))
    return spark.read.schema("org_id string, rows_processed bigint, jobs_run bigint, period date"
                             ).parquet(f"{place}/out")


def stream_key_links(spark, sf_dir):
    """Exact-key links of a stream against a registry; rows come in no order."""
    people, place = crm(spark, sf_dir), _place(spark, "registry")
    _run_sink(streams.register_keys(
        _feed(spark, people, _shuffled("row_id")), {f: f for f in fixed.KEY_CONFIDENCE},
        f"{place}/out", f"{place}/log"))
    return streams.key_links(spark, f"{place}/out")


def stream_subscription_state(spark, sf_dir):
    """Subscriptions from billing events in no order, some delivered twice."""
    log, place = billing(spark, sf_dir), _place(spark, "subscriptions")
    feed = _feed(spark, log, _shuffled("event_id", "ts"))
    _run_sink(subscriptions.write_subscriptions(feed, f"{place}/out", f"{place}/log"))
    return _plain(subscriptions.read_subscriptions(spark, f"{place}/out"), "period_end", "updated_at")


def stream_limits(spark, sf_dir):
    """Request limits of a live log, in the order of time from batch to batch."""
    log, place = _request_log(spark, sf_dir), _place(spark, "limits")
    low, high = log.selectExpr("min(unix_micros(ts))", "max(unix_micros(ts)) + 1").head()
    turn = F.expr(f"CAST((unix_micros(ts) - {low}) * 5 DIV {high - low} AS INT)")
    _run_sink(streams.write_limits(_feed(spark, log, turn), f"{place}/out", f"{place}/log"))
    return spark.read.parquet(f"{place}/out/answers").select(
        "event_id", "key", "allowed", "remaining", "retry_after", "limit")


def _grouped_flags(table, key, column, by, **how):
    def run(spark, sf_dir):
        out = grouped_outliers(load(spark, sf_dir, table), column, by, **how)
        return out.select(*key, F.round("score", 6).alias("score"), "is_outlier")
    return run


QUERIES = {
    "tax_id_findings": _verdicts("tax_id"),
    "iban_findings": _verdicts("iban"),
    "email_findings": _verdicts("email"),
    "phone_findings": _verdicts("phone"),
    "postal_findings": _verdicts("postal_code"),
    **{f"{kind}_edge_findings": _verdicts(kind, edges)
       for kind in ("tax_id", "iban", "email", "phone", "postal_code")},
    "typed_phone_findings": _verdicts("phone", typed),
    "typed_postal_findings": _verdicts("postal_code", typed),
    "edge_findings": edge_findings,
    "outlier_fallbacks": outlier_fallbacks,
    "document_emails": document_emails,
    "text_keys": _text(
        key=text.normalize_key, plain=text.strip_accents, spaced=text.collapse_spaces),
    "company_keys": _text(key=text.normalize_company),
    "title_names": _text(title=text.title_case_name),
    "slugs": _text(slug=text.slugify),
    "synthetic_names": _text(reason=text.synthetic_reason),
    "text_values": text_values,
    "rule_texts": rule_texts,
    "formatted_ibans": formatted_ibans,
    "findings": findings,
    "quarantine_split": quarantine_split,
    "row_conservation": row_conservation,
    "clean_values": _values(True),
    "audit_only": _values(False),
    "quality_gate": quality_gate,
    "outlier_model": outlier_models,
    "outlier_flags": _flags("events", ["event_id"], "value"),
    "outlier_flags_grouped": _grouped_flags("events", ["event_id"], "value", ["event_type"]),
    "outlier_flags_by_user": _grouped_flags("events", ["event_id"], "value", ["user_id"]),
    # Groups with more than 10 000 different values: ranks are found digit by digit.
    "outlier_flags_by_digits": _grouped_flags(
        "lineitem", ["l_orderkey", "l_linenumber"], "l_extendedprice",
        ["l_returnflag", "l_linestatus"], limit=10_000),
    "outlier_flags_lineitem": _flags(
        "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_extendedprice"),
    "domain_flags": domain_flags,
    "exact_key_links": exact_key_links,
    "name_keys": name_keys,
    "block_sizes": block_sizes,
    "candidate_pairs": candidate_pairs,
    "candidate_pairs_all_blocks": candidate_pairs,
    "duplicate_groups_exact": duplicate_groups_exact,
    "duplicate_members_exact": duplicate_members_exact,
    "duplicate_groups_full": duplicate_groups_full,
    "duplicate_rows_nested": duplicate_rows_nested,
    "duplicate_findings": duplicate_findings,
    "similar_name_groups": similar_name_groups,
    "similar_company_evidence": _similar_groups("company"),
    "similar_person_evidence": _similar_groups("name"),
    "pseudonymised": pseudonymised,
    "masked": masked,
    "counts_by_rule": counts_by_rule,
    "counts_by_severity": counts_by_severity,
    "top_rules": top_rules,
    "cost_total": cost_total,
    "audit_report": audit_report,
    "report_sections": report_sections,
    "worklist": worklist,
    "worklist_summary": worklist_summary,
    "monthly_usage": monthly_usage,
    "usage_remaining": usage_remaining,
    "quota_decisions": quota_decisions,
    "plan_from_amount": plan_from_amount,
    "relevant_billing_events": relevant_billing_events,
    "billing_organisations": billing_organisations,
    "subscription_state": subscription_state,
    "entitled_orgs": entitled_orgs,
    "billing_audit": billing_audit,
    "recent_runs": recent_runs,
    "retained_runs": retained_runs,
    "tenant_runs": tenant_runs,
    "over_limit_events": over_limit_events,
    "row_identity": row_identity,
    "row_identity_filtered": row_identity_filtered,
    "csv_round_trip": csv_round_trip,
    "records_round_trip": records_round_trip,
    "run_log_append": run_log_append,
    "run_log_retried": run_log_retried,
    "typed_values": typed_values,
    "worklist_csv": worklist_csv,
    "report_json": report_json,
    "schema_matches": schema_matches,
    "schema_matches_all_rows": schema_matches,
    "stream_findings": stream_verdicts,
    "stream_events": stream_events,
    "stream_split": stream_split,
    "stream_windows": stream_windows,
    "stream_usage": stream_usage,
    "stream_key_links": stream_key_links,
    "stream_limits": stream_limits,
    "stream_subscription_state": stream_subscription_state,
}
