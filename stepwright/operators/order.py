"""What needs an order of all rows: consecutive numbers, batches of like lengths, cyclic schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.tokens import padded
from stepwright.sources.jsonl import shared_path


def numbered(rows: DataFrame, by: list, name: str = "ordinal", start: int = 0) -> DataFrame:
    """Adds consecutive numbers in the order of ``by``, which should be unique for numbers that repeat in each run.

    Rows are dealt to tasks by ranges of ``by`` and written once, sorted, to a table in the shared folder (it
    stays there until that is cleared).  What reaches the driver is one count for each range, as many
    as shuffle partitions; a range's numbers start where the ranges before it end.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "numbered")
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt.select("*", F.spark_partition_id().alias("_range"), local.alias("_place")).write.parquet(path)
    written = spark.read.parquet(path)
    sizes, before, at = dict(written.groupBy("_range").count().collect()), [], start
    for r in sorted(sizes):
        before.append((r, at))
        at += sizes[r]
    shift = spark.createDataFrame(before, "_range int, _before long")
    return written.join(F.broadcast(shift), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")  # a row a range


def length_batches(rows: DataFrame, length: Column, key: str | list[str], size: int) -> DataFrame:
    """Adds ``batch, place, width``: batches of ``size`` rows of like lengths, the longest row's length as width.

    Rows are numbered by length and key, so a batch is padded to its own longest row and not to the longest of
    all.  Only the last batch may be smaller.
    """
    if size < 1:
        raise ValueError("size must be 1 at least")
    own = numbered(rows.withColumn("_length", length), ["_length", *([key] if isinstance(key, str) else key)], "_n")
    own = own.withColumn("batch", F.floor(F.col("_n") / size)).withColumn("place", (F.col("_n") % size).cast("int"))
    widths = own.groupBy(F.col("batch").alias("_b")).agg(F.max("_length").cast("int").alias("width"))
    return own.join(widths, F.col("batch") == F.col("_b")).drop("_length", "_n", "_b")


def padded_batches(rows: DataFrame, ids: str, key: str | list[str], size: int, fill=0, also: dict | None = None) -> DataFrame:
    """``length_batches`` with ``ids`` right-padded to the batch's width and an ``attention_mask``.

    ``also`` names more columns of the same lengths and what each is padded with.
    """
    out = length_batches(rows, F.size(ids), key, size)
    mask = padded(F.transform(ids, lambda x: F.lit(1)), F.col("width"), 0)
    more = {c: padded(F.col(c), F.col("width"), x) for c, x in (also or {}).items()}
    return out.withColumns({"attention_mask": mask, ids: padded(F.col(ids), F.col("width"), fill), **more})


def cyclic_batches(rows: DataFrame, by: list, steps: int, size: int, start: int = 0) -> DataFrame:
    """``step, place`` and the row's columns: step by step the next ``size`` rows in the order of ``by``, from the first again after the last.

    Steps are a range of numbers that meet the rows' numbers modulo their count, so a table that is gone
    through many times is joined, never looped over.  No rows give no batches.
    """
    own = numbered(rows, by, "_n")
    n = own.agg(F.max("_n")).first()[0]
    if n is None:
        return own.drop("_n").select(F.lit(0).cast("long").alias("step"), F.lit(0).alias("place"), "*")
    turns = rows.sparkSession.range(start * size, (start + steps) * size)
    turns = turns.select((F.col("id") % (n + 1)).alias("_n"), F.floor(F.col("id") / size).alias("step"), (F.col("id") % size).cast("int").alias("place"))
    return turns.join(own, "_n").drop("_n")
