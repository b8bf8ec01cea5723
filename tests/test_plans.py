"""Plans: no Python workers, no products of tables, narrow scans."""

import re

import pytest

from stepwright.plans import catalogue

#: Queries that put one row beside every row: totals of a vocabulary, the first failed call, a widest length.
ONE_ROW = {"masked_logp", "masked_logp_normalised", "preference_loss", "loss_metrics", "probe_deltas", "rejected_logp_annotation", "bigram_logp", "process_positive_metrics", "stop_at_provider_error", "padded_batch", "backoff_logp"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue_stays_in_the_engine(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", p)
    assert name in ONE_ROW or "NestedLoop" not in p


def test_scans_read_only_what_they_need(spark, sf):
    for name, most in (("success_rates", {"event_id", "user_id", "value"}), ("segment_conversations", {"conv_id", "turn", "role", "text"}), ("template_pairs", {"o_orderkey"}), ("pair_selection", {"doc_id", "lang", "source", "quality"})):
        read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalogue.QUERIES[name](spark, sf))))
        names = {c.split(":")[0] for r in read for c in r.split(",")}
        assert names and names <= most, (name, names)
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in plan(catalogue.QUERIES["segment_conversations"](spark, sf))


def test_row_wise_operators_do_not_shuffle(spark, sf):
    from pyspark.sql import functions as F

    from stepwright.operators import pairs as P
    from stepwright.plans import localisation as Z
    from stepwright.sources import generators as G

    rows = G.template_pairs(spark.range(100).select(F.col("id").alias("idx"), F.col("id").alias("seed")))
    for df in (Z.localise(rows), P.weight_variants(rows), P.noise_error(rows, "idx", 0.5), P.truncate_rejected(rows), Z.token_table(Z.localise(rows), "idx")):
        assert "Exchange" not in plan(df)


def test_numbers_need_no_single_task(spark, sf):
    for name in ("vocabulary_ids", "length_batches", "cyclic_batches"):
        assert "SinglePartition" not in plan(catalogue.QUERIES[name](spark, sf)) and "Window" not in plan(catalogue.QUERIES[name](spark, sf))


def test_a_verdict_reads_its_reply_once(spark):
    from pyspark.sql import functions as F

    from stepwright.operators.reports import parse_verdict

    p = spark.range(1).select(F.col("id").cast("string").alias("reply")).select(parse_verdict(F.col("reply"), F.lit(5)))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract", p)) <= 2 and len(re.findall("parse_json", p, re.I)) <= 1 and len(re.findall("variant_get|variantget", p, re.I)) <= 18


def test_distributions_read_a_gold_answer_once(spark):
    from pyspark.sql import functions as F

    from stepwright.operators import quality as Q
    from stepwright.sources import generators as G

    rows = G.template_pairs(spark.range(12).select(F.col("id").alias("idx"), F.col("id").alias("seed")))
    p = Q.distributions(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(.*?boxed", p)) == 3  # chosen, rejected, gold
    made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(rows._jdf.queryExecution().executedPlan())
    assert all(made.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(made.size()))  # the JVM compiles no longer method
