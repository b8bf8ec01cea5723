"""Step weights brought to tokens as a range join of two long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of one bucket.
BUCKET = 1024


def _buckets(start: Column, end: Column, width: int) -> Column:
    """The buckets that the characters from ``start`` to before ``end`` touch; an empty stretch touches its own."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(start, end - 1) / width).cast("long"))


def weights_by_span(tokens: DataFrame, spans: DataFrame, by: list[str], width: int = BUCKET) -> DataFrame:
    """``tokens(by, pos, start, end, ...)`` with ``w`` of the last of ``spans(by, k, start, end, w)`` that overlaps, 0.0 if none does.

    Both sides are cut into buckets of ``width`` characters and meet by bucket, so a very long text is
    spread over many tasks; a token or span that crosses buckets stands in each of them, and a token that has
    met a span twice keeps one weight.  Spans without a place or weight count for nothing.  The token's other
    columns are not moved for the search.
    """
    own = tokens.select(*by, "pos", F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_bucket", F.explode(_buckets(F.col("_s"), F.col("_e"), width)))
    known = spans.where("start is not null and end is not null and w is not null").select(*by, "k", F.col("start").alias("_a"), F.col("end").alias("_z"), "w")
    known = known.withColumn("_bucket", F.explode(_buckets(F.col("_a"), F.col("_z"), width)))
    # both joins by merge: a planner that takes rows before an explode for their size would bring the spans, or all weights, to the driver
    hit = own.join(known.hint("merge"), [*by, "_bucket"]).where((F.col("_e") > F.col("_a")) & (F.col("_s") < F.col("_z")))
    best = hit.groupBy(*by, "pos").agg(F.max_by("w", "k").alias("w"))
    return tokens.join(best.hint("merge"), [*by, "pos"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
