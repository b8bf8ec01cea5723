"""Completions from outside the engine: a replay table, or a function called for batches of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jsonl import Increments

CACHE = T.StructType([T.StructField("id", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("sample_no", T.IntegerType()), T.StructField("completion", T.StringType())])


def ask(rows: DataFrame, n: int, prompt: str = "prompt") -> DataFrame:
    """Each row ``n`` times with ``sample_no`` from 1."""
    return rows.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else rows.withColumn("sample_no", F.lit(1)).where(F.lit(False))


def replay(rows: DataFrame, completions: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``completion`` from ``completions(prompt, sample_no, completion)``; null where none was recorded.

    Prompts meet by hash and text, so long prompts are compared only where hashes agree.
    """
    table = completions.select(F.xxhash64("prompt").alias("_h"), F.col("prompt").alias("_p"), F.col("sample_no").alias("_n"), "completion")
    own = rows.withColumn("_h", F.xxhash64(prompt))
    return own.join(table, (own["_h"] == table["_h"]) & (own[prompt] == F.col("_p")) & (own["sample_no"] == F.col("_n")), "left").drop("_h", "_p", "_n")


def generate(rows: DataFrame, provider: Callable[[list[str]], list[tuple[str | None, str | None]]], prompt: str = "prompt") -> DataFrame:
    """``completion`` and ``error`` from ``provider``, called with one Arrow batch of prompts at a time."""
    schema = T.StructType([*rows.schema.fields, T.StructField("completion", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator):
        for pdf in batches:
            got = provider(pdf[prompt].tolist())
            yield pdf.assign(completion=[g[0] for g in got], error=[g[1] for g in got])

    return rows.mapInPandas(run, schema)


def cached(rows: DataFrame, provider: Callable, path: str, prompt: str = "prompt", retries: int = 1) -> DataFrame:
    """``rows(prompt, sample_no)`` with ``completion`` and ``error``, from the cache at ``path`` before ``provider``.

    The cache is a table of committed increments by hash of prompt and sample number.  Only what it lacks is asked, each prompt and
    number once however many rows have it, and written before it is read; what failed is asked again up to ``retries`` times
    and never written, so that a later run asks for it once more.  A run that was killed leaves whole increments or
    nothing.
    """
    spark = rows.sparkSession
    cache = Increments(spark, path, CACHE, "id")
    id_ = F.sha2(F.concat(F.col("sample_no").cast("string"), F.lit(":"), F.col(prompt)), 256)
    own = rows.withColumn("_id", id_)
    for _ in range(retries + 1):
        known = cache.rows().select("id")
        open_ = own.join(known, F.col("_id") == F.col("id"), "left_anti").select(F.col("_id").alias("id"), F.col(prompt).alias("prompt"), F.col("sample_no").cast("int").alias("sample_no")).dropDuplicates(["id"])
        if open_.isEmpty():
            break
        cache.append(f"increment-{len(cache.committed()):06d}", generate(open_, provider).where("error is null").drop("error"))
    said = cache.rows().select(F.col("id").alias("_cid"), "completion", F.lit(True).alias("_said"))
    out = own.join(said, F.col("_id") == F.col("_cid"), "left")
    return out.withColumn("error", F.when(F.col("_said").isNull(), "no completion")).drop("_id", "_cid", "_said")


def until_first_error(rows: DataFrame, order: str = "idx") -> DataFrame:
    """Rows before the first, by ``order``, whose provider call failed."""
    first = rows.where(F.col("error").isNotNull()).agg(F.min(order).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")  # one row
