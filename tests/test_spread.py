"""Work is dealt to many tasks where a table's files are few."""

from pyspark.sql import functions as F

from tersa.operators import accounts, evaluate as ev
from tersa.operators.worklist import build_worklist
from tersa.plans import queries
from tersa.sources import io
from tersa.streaming import subscriptions


def test_a_compact_table_is_dealt_to_many_tasks(spark, sf_dir, monkeypatch):
    few = queries.crm(spark, sf_dir).sort("row_id").collect()
    monkeypatch.setattr(io, "_FEW_ROWS", 20)
    people = queries.crm(spark, sf_dir)
    assert people.rdd.getNumPartitions() > 1
    assert people.sort("row_id").collect() == few


def test_tasks_grow_with_the_rows(spark):
    most = 4 * spark.sparkContext.defaultParallelism
    assert [io.tasks_for(spark, n) for n in (0, 20_000, 20_001)] == [1, 1, 2]
    assert io.tasks_for(spark, 20_000 * most) == most
    assert io.tasks_for(spark, 10 ** 9) == 4_000


def test_a_turn_of_many_rows_is_one_batch_of_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(io, "_FEW_ROWS", 20)
    rows = spark.range(100).selectExpr("id", "CASE WHEN id < 94 THEN 0 WHEN id < 96 THEN 2 END AS t")
    seen = []

    def look(batch, _):
        rows = batch.select("id", F.input_file_name().alias("file")).collect()
        seen.append((sorted(r.id for r in rows), len({r.file for r in rows})))

    feed = queries._feed(spark, rows, F.col("t"), files=3)
    queries._run_sink(feed.writeStream.foreachBatch(look).option(
        "checkpointLocation", str(tmp_path / "log")))
    assert [ids for ids, _ in seen] == [list(range(94)), [], [94, 95]]
    assert seen[0][1] == 5


def test_a_list_is_written_before_it_is_sorted(spark, sf_dir):
    lines = build_worklist(ev.evaluate(queries.crm(spark, sf_dir), queries.FIELDS), queries.FIELDS)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Sort" in plan and "Generate" not in plan


def test_events_with_a_name_do_not_wait(spark, tmp_path):
    """Only events without an organisation are kept to be resolved again."""
    log, place = queries.billing(spark, "/root/testdata/sf0.001").limit(300), str(tmp_path / "s")
    feed = queries._feed(spark, log, queries._shuffled("event_id", "ts", files=2), 2)
    queries._run_sink(subscriptions.write_subscriptions(feed, place, place + "-log", buckets=2))
    waiting = spark.read.parquet(f"{place}/events")
    assert waiting.where("nullif(org_id, '') IS NOT NULL").isEmpty() and not waiting.isEmpty()
    want = accounts.subscription_state(log).collect()
    assert sorted(subscriptions.read_subscriptions(spark, place).collect()) == sorted(want)
