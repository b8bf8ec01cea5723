"""Filters with reasons, and distributions of pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.text import answer_side, rstrip, same_answer

REASONS = ("low_confidence", "last_error", "gold_fallback_chosen", "truncated")


def looks_truncated(c: Column, least: int = 80) -> Column:
    """Shorter than ``least`` characters, or ending in an operator, colon or comma."""
    t = rstrip(c)
    return (F.length(t) < least) | t.rlike(r"[=+\-*/:,]\z")


def reject_reason(rows: DataFrame, least: float = 0.9, not_last: bool = True, sampled: bool = True, truncated: bool = True) -> DataFrame:
    """Adds ``reject_reason``: the first rule that a row fails, null for rows to keep."""
    reason = F.when(F.coalesce(F.col("localization_confidence"), F.lit(0.0)) < least, REASONS[0])
    if not_last:
        reason = reason.when(F.col("first_error_step") >= F.size("rejected_steps") - 1, REASONS[1])
    if sampled:
        reason = reason.when(~F.coalesce(F.col("has_sampled_chosen"), F.lit(False)), REASONS[2])
    if truncated:
        reason = reason.when(looks_truncated(F.col("rejected")), REASONS[3])
    return rows.withColumn("reject_reason", reason)


def reject_stats(reasoned: DataFrame) -> DataFrame:
    """Rows for each reason, those without any included, in one pass."""
    one = reasoned.agg(F.count("*").alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS])
    names = ("total", "kept", *REASONS)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n_rows")) for n in names])).alias("x")).select("x.*")


def distributions(rows: DataFrame) -> DataFrame:
    """``measure, value, n``: step counts, first errors, confidences, templates, verdicts and, where known, sampled chosen traces, in one aggregation.

    A row's gold answer is read once for both verdicts.
    """
    verdict = lambda c: same_answer(F.col(c), F.col("_gold"))
    cells = [
        ("step_count", F.size("rejected_steps").cast("string")),
        ("first_error", F.col("first_error_step").cast("string")),
        ("confidence", F.format_string("%.2f", F.col("localization_confidence"))),
        ("template", F.col("template")),
        ("chosen_correct", verdict("chosen").cast("string")),
        ("rejected_wrong", (~verdict("rejected")).cast("string")),
        ("not_last_first_error", (F.col("first_error_step") < F.size("rejected_steps") - 1).cast("string")),
    ]
    if "has_sampled_chosen" in rows.columns:
        cells.append(("sampled_chosen", F.coalesce(F.col("has_sampled_chosen"), F.lit(False)).cast("string")))
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("value")) for n, v in cells]))
    return rows.withColumn("_gold", answer_side(F.col("answer"))).select(x.alias("x")).groupBy("x.measure", "x.value").agg(F.count("*").alias("n"))
