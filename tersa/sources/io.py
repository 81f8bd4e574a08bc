"""Readers, writers and row identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTITION_SHIFT = 33  # monotonically_increasing_id: partition above, position below


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. All text: type inference would eat leading zeros."""
    return (
        spark.read.option("header", True).option("multiLine", False)
        .option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON rows with a declared schema, so nothing is read twice."""
    return spark.read.schema(schema).json(path)


#: Rows of a task where there are few of them, and where there are many.
_FEW_ROWS, _MANY_ROWS = 20_000, 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that ``rows`` keep busy: some for each core, and more where these would be long."""
    most = 4 * spark.sparkContext.defaultParallelism
    return max(1, min(-(-rows // _FEW_ROWS), most), -(-rows // _MANY_ROWS))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal the rows of a table to as many tasks as their number is worth.

    Files are split by bytes: a compact one of a million short rows is a task or two,
    however much is computed on each row. Small tables stay as they are. ``rows`` (counted
    if not given) must be given for a stream. Use it on files: the rows are read once more.
    """
    parts = tasks_for(df.sparkSession, df.count() if rows is None else rows)
    return df.repartition(parts) if parts > 1 else df


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows 0..n-1 in input order without gathering them in one task.

    One counting job gives the rows of each partition; their running total, one
    number per partition, is broadcast and added to the position inside the
    partition. Both jobs must see the same partitions: use it on files or on a
    materialised table.
    """
    mark = F.monotonically_increasing_id()
    # Bounded by the number of input partitions, not by the rows.
    sizes = sorted(
        df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    offsets, total = [], 0
    for partition, rows in sizes:
        offsets.append((partition, total))
        total += rows
    if all(partition == 0 for partition, _ in offsets):  # all in the first partition, or no rows
        return df.select(mark.alias(name), "*")
    table = df.sparkSession.createDataFrame(offsets, "__part int, __offset bigint")
    marked = df.select("*", mark.alias("__mark")).withColumn(
        "__part", F.shiftrightunsigned("__mark", _PARTITION_SHIFT).cast("int"))
    local = F.col("__mark").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return marked.join(F.broadcast(table), "__part").select(
        (F.col("__offset") + local).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN has no JSON form and means "absent" in every numeric column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({
        c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats
    }) if floats else df


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Valid rows, quarantine or worklist, written in parallel by the executors."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nan_to_null(df).write.mode(mode).json(path)


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append to a Parquet log (runs, audit), laid out by organisation if asked."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_batch(df: DataFrame, path: str, batch: str | int, partition_by: str | None = None) -> None:
    """Append under a batch id: a retried job replaces what its first attempt wrote.

    Each batch owns ``path/batch=<id>``, within it laid out by organisation if asked,
    so readers of one organisation still open its folders alone.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/batch={batch}")


def write_ordered(df: DataFrame, path: str, keys: list, fmt: str = "csv") -> None:
    """Files whose names keep the order of ``keys``: read by name, they are the sorted list.

    A range partition per file, sorted within. ``keys`` should tell all rows apart, so
    that rows alike in the first ones are split as well.
    """
    write_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, fmt)


def read_ordered(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """CSV files of ``write_ordered`` with the place of each row in the list, from 0."""
    rows = read_table(spark, path).select("*", F.col("_metadata.file_name").alias("__file"),
                                          F.col("_metadata.file_block_start").alias("__block"),
                                          F.monotonically_increasing_id().alias("__mark"))
    sizes = rows.groupBy("__file", "__block").agg(
        F.count("*").alias("n"), F.min("__mark").alias("__first")).collect()  # one row per split
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["__file"], r["__block"])):
        offsets.append((r["__file"], r["__block"], total - r["__first"]))
        total += r.n
    if not offsets:
        return rows.drop("__file", "__block", "__mark").withColumn(place, F.lit(0).cast("long"))
    table = spark.createDataFrame(offsets, "__file string, __block bigint, __shift bigint")
    return rows.join(F.broadcast(table), ["__file", "__block"]).withColumn(
        place, F.col("__mark") + F.col("__shift")).drop("__file", "__block", "__mark", "__shift")
