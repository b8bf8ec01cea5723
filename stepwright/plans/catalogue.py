"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.functions import steps as S
from stepwright.functions import tokens as K
from stepwright.functions.segment import segment_steps, step_spans
from stepwright.functions.text import WS, extract_answer, normalize_answer, verify_answer
from stepwright.operators import intervals as I
from stepwright.operators import order as O
from stepwright.operators import pairs as P
from stepwright.operators import quality as Q
from stepwright.operators import reports as R
from stepwright.operators import scores as L
from stepwright.sources import generators as G
from stepwright.sources import prompts as M
from stepwright.sources import providers as V
from stepwright.sources import jsonl as J
from stepwright.sources.jsonl import as_metadata, as_pairs, merge_metadata, metadata_map
from stepwright import streaming

from . import localisation as Z

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few file splits dealt to all cores before heavy expressions; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def dealt(keys: DataFrame, most: int) -> DataFrame:
    """Keys that will grow into texts or tokens, dealt to tasks of ``most`` keys or fewer, and to all cores at least."""
    return keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // most)))


def _seeds(spark, sf) -> DataFrame:
    return dealt(table(spark, sf, "orders").select("o_orderkey"), 1 << 16).select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("seed"))


def _few_seeds(spark, sf) -> DataFrame:
    return dealt(table(spark, sf, "customer").select("c_custkey"), 1 << 14).select(F.col("c_custkey").alias("idx"), F.col("c_custkey").alias("seed"))


def _pairs(spark, sf) -> DataFrame:
    return G.template_pairs(_seeds(spark, sf))


def _md5(steps) -> F.Column:
    return F.md5(F.array_join(steps, "|"))


def _joined(values, digits: int = 6):
    return F.array_join(F.transform(values, lambda x: F.format_string(f"%.{digits}f", x)), ",")


# Segmentation


def _assistant(spark, sf) -> DataFrame:
    c = spread(table(spark, sf, "conversations").where("role = 'assistant'"))
    return c.withColumn("steps", segment_steps(F.col("text")))


@query
def flagship_step_weights(spark, sf):
    """Assistant turns cut into steps, a first error by key, decayed weights, and their mean by place."""
    c = _assistant(spark, sf).where(F.size("steps") > 0)
    w = S.decayed(F.size("steps"), F.pmod(F.col("conv_id") + F.col("turn"), F.size("steps")).cast("int"), 0.25)
    return c.select(F.posexplode(w).alias("step_idx", "w")).groupBy("step_idx").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("sum_weight"))


@query
def segment_documents(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("steps", segment_steps(F.col("text")))
    return d.select("doc_id", F.size("steps").alias("n_steps"), _md5("steps").alias("steps_md5"))


@query
def segment_conversations(spark, sf):
    return _assistant(spark, sf).select("conv_id", "turn", F.size("steps").alias("n_steps"), _md5("steps").alias("steps_md5"))


@query
def segment_numbered(spark, sf):
    i = F.col("idx").cast("string")
    text = F.concat(F.lit("1. Take "), i, F.lit(" and add 2. Step 2: double it to get more (3) check that "), i, F.lit(" is right"))
    s = _few_seeds(spark, sf).withColumn("steps", segment_steps(text))
    return s.select("idx", F.size("steps").alias("n_steps"), F.array_join("steps", "|").alias("steps"))


@query
def segment_connectors(spark, sf):
    i = F.col("idx").cast("string")
    text = F.concat(F.lit("We have "), i, F.lit(" items so we count them. Then we add more, hence the total grows"))
    s = _few_seeds(spark, sf).withColumn("steps", segment_steps(text))
    return s.select("idx", F.size("steps").alias("n_steps"), F.array_join("steps", "|").alias("steps"))


@query
def segment_sentences(spark, sf):
    i = F.col("idx").cast("string")
    text = F.concat(F.lit("There are "), i, F.lit(" items. Ok. Nine more arrive; all of them stay. End"))
    s = _few_seeds(spark, sf).withColumn("steps", segment_steps(text))
    return s.select("idx", F.size("steps").alias("n_steps"), F.array_join("steps", "|").alias("steps"))


@query
def step_count_dist(spark, sf):
    return _assistant(spark, sf).groupBy(F.size("steps").alias("n_steps")).agg(F.count("*").alias("n"))


@query
def step_length_stats(spark, sf):
    s = _assistant(spark, sf).select(F.explode("steps").alias("s"))
    return s.agg(F.count("*").alias("n_steps"), F.min(F.length("s")).alias("shortest"), F.max(F.length("s")).alias("longest"), F.round(F.avg(F.length("s")), 6).alias("mean_chars"))


@query
def reasoning_length(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.size(F.regexp_extract_all("text", F.lit(rf"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))
    return c.groupBy("role").agg(F.round(F.avg(n), 6).alias("mean_tokens"), F.count("*").alias("n"))


# Answers


def _answers(spark, sf) -> DataFrame:
    i = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 9 + 1).alias("d"))
    s = lambda c: F.col(c).cast("string")
    text = (
        F.when(F.col("l_linenumber") % 6 == 0, F.concat(F.lit("We compute 7 and 8. #### "), s("l_partkey")))
        .when(F.col("l_linenumber") % 6 == 1, F.concat(F.lit("So the answer is \\boxed{"), s("q"), F.lit("/"), s("d"), F.lit("}.")))
        .when(F.col("l_linenumber") % 6 == 2, F.concat(F.lit("The answer is $"), s("q"), F.lit(".50 dollars")))
        .when(F.col("l_linenumber") % 6 == 3, F.concat(F.lit("First 12, then "), s("q"), F.lit(" in all")))
        .when(F.col("l_linenumber") % 6 == 4, F.lit("answer: none at all"))
        .otherwise(F.lit("  "))
    )
    return i.withColumn("text", text)


@query
def answer_extraction(spark, sf):
    a = _answers(spark, sf)
    x = extract_answer(F.col("text"))
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "q", x.alias("extracted"), normalize_answer(x).alias("normalised"))


@query
def answer_verification(spark, sf):
    a = _answers(spark, sf)
    gold = F.concat(F.lit("#### "), F.when(F.col("l_linenumber") % 6 == 1, F.round(F.col("q") / F.col("d"), 6).cast("string")).otherwise(F.format_string("%d", F.col("q"))))
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "q", verify_answer(F.col("text"), gold).alias("correct"))


@query
def page_numbers(spark, sf):
    """The plain-number branch over raw pages."""
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", extract_answer(F.col("html")).alias("extracted"))


# Generators


@query
def toy_questions(spark, sf):
    return G.toy_questions(_seeds(spark, sf))


@query
def template_eval(spark, sf):
    return G.template_eval(_seeds(spark, sf))


@query
def template_pairs(spark, sf):
    return _pairs(spark, sf).select("idx", "prompt", "chosen", "rejected", "answer", "first_error_step", "template")


@query
def placeholder_pairs(spark, sf):
    return G.placeholder_pairs(G.toy_questions(_few_seeds(spark, sf)))


@query
def head_questions(spark, sf):
    return G.head(G.toy_questions(_seeds(spark, sf)), 100)


@query
def pair_records(spark, sf):
    rows = G.placeholder_pairs(G.toy_questions(_few_seeds(spark, sf)))
    return as_pairs(rows).select("prompt", "chosen", "rejected", "answer", F.size(metadata_map(F.col("metadata"))).alias("n_metadata"))


# Prompts


@query
def prompt_forms(spark, sf):
    q = G.toy_questions(_few_seeds(spark, sf))
    steps = F.array(F.lit("one "), F.lit("two"))
    p = M.question(F.col("question"))
    return q.select(
        "idx",
        M.eval_prompt(p).alias("eval"),
        M.eval_prompt(F.concat(p, F.lit("\n#### ?"))).alias("marked"),
        M.eval_prompt(M.question(F.col("question"), M.NUMBERED_STEPS)).alias("numbered"),
        M.elicit_chosen(F.col("question"), F.col("answer")).alias("chosen"),
        M.elicit_rejected(F.col("question"), F.col("answer")).alias("rejected"),
        M.rollout_prompt(F.concat(p, F.lit(" \n")), steps, F.lit(0)).alias("rollout"),
        M.rollout_prompt_api(p, steps, F.lit(1)).alias("rollout_api"),
        M.judge_prompt(p, F.col("answer"), steps).alias("judge"),
    )


@query
def repair_elicited(spark, sf):
    q = G.toy_questions(_few_seeds(spark, sf))
    wrong = F.lit("so #### 1")
    rows = q.withColumn("chosen", F.when(F.col("idx") % 3 == 0, wrong).otherwise(F.concat(F.lit("thus "), F.col("answer")))).withColumn("rejected", F.when(F.col("idx") % 5 == 0, F.col("answer")).otherwise(wrong))
    return P.repair_elicited(rows).select("idx", "chosen", "rejected")


# Errors and weights


@query
def arithmetic_errors(spark, sf):
    p = _pairs(spark, sf)
    return p.select("idx", S.arithmetic_error(F.col("prompt"), F.col("rejected_steps")).alias("rejected_error"), S.arithmetic_error(F.col("prompt"), F.col("chosen_steps")).alias("chosen_error"))


@query
def toy_arithmetic_errors(spark, sf):
    q = G.toy_questions(_few_seeds(spark, sf))
    a, b, c = F.col("idx") + 12, F.col("idx") % 7 + 3, F.col("idx") % 5 + 2
    f = F.format_string
    steps = F.array(f("%d × %d = %d", a, b, a * b + F.when(F.col("idx") % 4 == 0, 1).otherwise(0)), f("%d + %d = %d", a * b, c + F.when(F.col("idx") % 4 == 1, 1).otherwise(0), a * b + c + F.when(F.col("idx") % 4 == 1, 1).otherwise(0)), F.lit("#### 1"))
    has = F.replace(F.col("question"), F.lit("A box has"), F.lit("It has"))
    return q.select("idx", S.arithmetic_error(has, steps).alias("error"))


def _exploded(rows, name):
    return rows.select("idx", name, F.posexplode("step_weights").alias("k", "w"))


@query
def weight_variants(spark, sf):
    return P.weight_variants(_pairs(spark, sf).select("idx", "rejected_steps", "first_error_step")).select("idx", "weight_variant", _joined("step_weights", 4).alias("weights"))


@query
def decayed_weights(spark, sf):
    p = _pairs(spark, sf)
    m = F.col("first_error_step") + (F.col("idx") % 7).cast("int") - 2
    return p.select("idx", _joined(S.decayed(F.size("rejected_steps"), m, 0.25)).alias("clamped"), _joined(S.decayed(F.size("rejected_steps"), m, 0.25, clamp=False)).alias("unclamped"))


@query
def probe_masks(spark, sf):
    p = _pairs(spark, sf).withColumn("probe", F.explode(F.array(*map(F.lit, S.PROBES))))
    return p.withColumn("step_weights", S.probe_weights(F.size("rejected_steps"), F.col("first_error_step"), F.col("probe"), 0.5)).groupBy("probe", "template").agg(F.round(F.sum(F.aggregate("step_weights", F.lit(0.0), lambda a, x: a + x)), 6).alias("mass"), F.count("*").alias("n"))


def _rates(spark, sf) -> DataFrame:
    i = table(spark, sf, "lineitem")
    key = F.struct("l_linenumber", "l_discount")
    got = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(key.alias("o"), (F.col("l_discount") * 10).alias("q")))).alias("x"))  # an order has few lines
    return got.select("l_orderkey", F.transform("x", lambda e: F.round(e["q"], 6)).alias("rates"))


@query
def localize_rates(spark, sf):
    r = _rates(spark, sf).withColumn("loc", S.localize(F.col("rates")))
    return r.select("l_orderkey", F.size("rates").alias("n"), F.col("loc.first_error").alias("first_error"), F.round("loc.confidence", 6).alias("confidence"))


@query
def heuristic_rates(spark, sf):
    p = _pairs(spark, sf)
    r = S.heuristic_rates(F.col("chosen_steps"), F.col("answer"))
    w = S.heuristic_rates(F.col("rejected_steps"), F.col("answer"))
    return p.select("idx", _joined(F.slice(w, F.size(w), F.lit(1)), 1).alias("rejected_last"), F.try_element_at(r, F.lit(-1)).alias("chosen_last"), F.size(r).alias("n"))


@query
def localisation_cascade(spark, sf):
    p = _pairs(spark, sf).drop("localization_confidence")
    kind = F.col("idx") % 4
    rows = p.select(
        "idx",
        "prompt",
        F.when(kind == 0, F.col("rejected_steps")).otherwise(F.array(F.lit("first we look"), F.lit("then we guess"), F.lit("#### -5"))).alias("rejected_steps"),
        F.lit("unused").alias("rejected"),
        "answer",
        F.when(kind == 1, F.array(F.lit(0.9), F.lit(0.9), F.lit(0.1))).alias("prefix_success_rates"),
        F.when(kind == 2, F.lit(1)).alias("first_error_step"),
    )
    z = Z.localise(rows, gamma=0.5)
    return z.select("idx", "branch", "first_error_step", F.round("localization_confidence", 6).alias("confidence"), _joined("step_weights").alias("weights"))


# Variants of labelled pairs


@query
def shift_error(spark, sf):
    p = _pairs(spark, sf)
    up, down = (P.shift_error(p, by).select("idx", F.col("first_error_step").alias("m"), _joined("step_weights").alias("w")) for by in (1, -1))
    return up.withColumn("shift", F.lit(1)).unionByName(down.withColumn("shift", F.lit(-1)))


@query
def noise_error(spark, sf):
    return P.noise_error(_pairs(spark, sf), "idx", 0.25).select("idx", "first_error_step", "localization_noisy")


@query
def truncate_rejected(spark, sf):
    return P.truncate_rejected(_pairs(spark, sf)).select("idx", "rejected", "first_error_step", F.size("step_weights").alias("n"))


@query
def positive_prefix(spark, sf):
    return P.positive_prefix(_pairs(spark, sf)).select("idx", "positive_prefix")


@query
def metadata_merge(spark, sf):
    e = table(spark, sf, "events")
    merged = merge_metadata(as_metadata(a=F.col("event_type"), b=F.lit("old"), n=F.lit(1)), as_metadata(b=F.col("user_id"), c=F.lit(0.5), n=F.lit(None).cast("string")))
    got = e.select("event_id", merged.alias("m"))
    return got.select("event_id", F.try_variant_get("m", "$.a", "string").alias("a"), F.try_variant_get("m", "$.b", "bigint").alias("b"), F.to_json("m").alias("merged"), F.size(metadata_map(F.col("m"))).alias("n"))


# Selection, filters, splits


@query
def pair_selection(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select("lang", "source", "doc_id", F.col("doc_id").cast("string").alias("text"), (F.col("quality") == 1).alias("ok"), F.lit("gold").alias("gold"))
    return P.select_pairs(rows, ["lang", "source"], "text", "doc_id", "ok", "gold")


def _to_filter(spark, sf) -> DataFrame:
    p = _pairs(spark, sf)
    m = F.when(F.col("idx") % 8 == 1, F.size("rejected_steps") - 1).otherwise(F.col("first_error_step"))
    short = F.when(F.col("idx") % 5 == 2, F.lit("Short text, ")).otherwise(F.col("rejected"))
    return p.withColumn("first_error_step", m).withColumn("rejected", short).withColumn("localization_confidence", F.when(F.col("idx") % 7 == 0, F.lit(None)).otherwise((F.col("idx") % 11) / 10)).withColumn("has_sampled_chosen", F.when(F.col("idx") % 3 > 0, F.col("idx") % 3 == 1))


@query
def quality_filter(spark, sf):
    return Q.reject_reason(_to_filter(spark, sf), least=0.5).select("idx", "reject_reason")


@query
def reject_stats(spark, sf):
    return Q.reject_stats(Q.reject_reason(_to_filter(spark, sf), least=0.5))


@query
def truncated_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(Q.looks_truncated(F.col("text")).alias("truncated")).agg(F.count("*").alias("n"))


@query
def pair_distributions(spark, sf):
    return Q.distributions(_pairs(spark, sf).withColumn("has_sampled_chosen", F.when(F.col("idx") % 5 > 0, F.col("idx") % 3 == 0)))


@query
def split_exact(spark, sf):
    return P.split_exact(table(spark, sf, "documents").select("doc_id"), 0.8, "doc_id")


# Rollouts and reports


@query
def success_rates(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 5).alias("k"), (F.col("value") > 40).alias("ok"))
    return R.success_rates(e, "user_id", "k", "ok").select("user_id", _joined("rates").alias("rates"))


@query
def rollouts_replayed(spark, sf):
    """Prompts of every prefix, two completions each, verified and averaged; replay_join reads them from a table."""
    p = _pairs(spark, sf).select("idx", "prompt", "rejected_steps", "answer", F.explode(F.sequence(F.lit(0), F.size("rejected_steps") - 1)).alias("k"))
    asked = V.ask(p.withColumn("rollout", M.rollout_prompt(F.col("prompt"), F.col("rejected_steps"), F.col("k"))), 2)
    said = asked.select("idx", "k", "sample_no", "answer", F.when((F.col("idx") + F.col("k") + F.col("sample_no")) % 3 == 0, F.col("answer")).otherwise(F.lit("#### -1")).alias("completion"))
    ok = said.withColumn("ok", verify_answer(F.col("completion"), F.col("answer")))
    return R.success_rates(ok, "idx", "k", "ok").select("idx", _joined("rates").alias("rates"))


@query
def replay_join(spark, sf):
    q = G.toy_questions(_few_seeds(spark, sf)).select("idx", F.col("question").alias("prompt"))
    kept = q.where(F.col("idx") % 2 == 0).select("prompt", F.lit(1).alias("sample_no"), F.concat(F.lit("reply "), F.col("idx").cast("string")).alias("completion"))
    return V.replay(V.ask(q, 2), kept).select("idx", "sample_no", "completion")


@query
def stop_at_provider_error(spark, sf):
    q = _few_seeds(spark, sf).withColumn("error", F.when((F.col("idx") % 200 == 150), F.lit("timeout")))
    return V.until_first_error(q).select("idx")


def _details(spark, sf) -> DataFrame:
    e = spread(table(spark, sf, "events").select("event_id", "event_type", "user_id"))
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("#### "), (F.col("user_id") + 1).cast("string"))).otherwise(F.concat(F.lit("The answer is "), F.col("user_id").cast("string")))
    return R.generation_details(e.select(F.col("event_type").alias("model"), F.col("event_id").alias("idx"), F.lit("p").alias("prompt"), F.concat(F.lit("#### "), F.col("user_id").cast("string")).alias("gold"), said.alias("prediction")))


@query
def generation_details(spark, sf):
    return _details(spark, sf).select("model", "idx", "pred_answer", "correct")


@query
def accuracy_summary(spark, sf):
    d = _details(spark, sf)
    models = d.select("model").union(d.sparkSession.createDataFrame([("nobody",)], "model string"))
    return R.accuracy(d, models).select("model", F.round("accuracy", 6).alias("accuracy"), "correct", "total")


@query
def template_accuracy(spark, sf):
    p = _pairs(spark, sf)
    d = p.select("template", verify_answer(F.when(F.col("idx") % 4 == 0, F.col("chosen")).otherwise(F.col("rejected")), F.col("answer")).alias("correct"))
    return R.accuracy(d, by="template").select("template", F.round("accuracy", 6).alias("accuracy"), "correct", "total")


@query
def accuracy_over_seeds(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 3).alias("seed")).agg(F.avg((F.col("value") > 50).cast("double")).alias("accuracy"))
    return R.over_seeds(e, "event_type", "accuracy").select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query
def judge_verdicts(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id"))
    m, c = (F.col("event_id") % 9 - 2).cast("string"), F.format_string("%.1f", (F.col("event_id") % 14) / 10)
    kind = F.col("event_id") % 10
    fixed = {
        0: "I can not say.",
        1: 'see {"first_error_step": 1, "confidence": ',
        2: '{"first_error_step": 1, "confidence": "high"}',
        3: '{"first_error_step": 1, "confidence": null, "rationale": "x"}',
        5: '{"first_error_step": 1, }',
        6: '{"first_error_step": "2.5", "confidence": 1, "rationale": null}',
        7: '{"first_error_step": " 3 ", "confidence": " 0.5 ", "rationale": "  spaced out\\n "}',
        8: '{"first_error_step": 2.9, "confidence": 7}',
    }
    reply = F.when(kind == -1, "")
    for k, v in fixed.items():
        reply = reply.when(kind == k, v)
    reply = reply.otherwise(F.concat(F.lit('Sure:\n{"first_error_step": '), m, F.lit(', "confidence": '), c, F.lit(', "rationale": "r'), m, F.lit('"}\nDone.')))
    return e.select("event_id", R.parse_verdict(reply, F.lit(5)).alias("v")).select("event_id", "v.*")


# Tokens, scores, loss


@query
def token_offsets(spark, sf):
    c = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return c.select("conv_id", "turn", F.posexplode(K.scan(F.col("text"))).alias("pos", "t")).select("conv_id", "turn", "pos", "t.token", "t.start", F.col("t.end").alias("end_"))


@query
def step_char_spans(spark, sf):
    p = G.template_pairs(_few_seeds(spark, sf))
    return p.select("idx", F.posexplode(step_spans(F.col("rejected"), F.col("rejected_steps"))).alias("k", "s")).select("idx", "k", "s.start", F.col("s.end").alias("end_"))


def _localised(spark, sf) -> DataFrame:
    p = G.template_pairs(_few_seeds(spark, sf))
    return p.withColumn("step_weights", S.decayed(F.size("rejected_steps"), F.col("first_error_step"), 0.5))


def _tokens(spark, sf) -> DataFrame:
    """Token rows as a table: what counts them and what scores them both read it; nothing here reads places in the text."""
    return J.stored(Z.token_table(_localised(spark, sf), "idx", places=False), "tokens")


def _token_ids(toks: DataFrame) -> DataFrame:
    """Ids of tokens by first places: the first row by a sum of keys alone, then its side and place among the rows of that key."""
    low = L.lookup(toks.groupBy("token").agg(F.min("idx").alias("first_row")))
    own = toks.join(low, "token").where(F.col("idx") == F.col("first_row"))
    return P.vocabulary_ids(own.groupBy("token", "first_row").agg(F.min(F.struct("side", "pos")).alias("first_pos")))


@query
def token_weights(spark, sf):
    return Z.token_table(_localised(spark, sf), "idx").select("idx", "side", "pos", "token", F.round("w", 6).alias("w"))


@query
def vocabulary(spark, sf):
    return P.vocabulary(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id")


@query
def vocabulary_ids(spark, sf):
    return P.vocabulary_ids(P.vocabulary(table(spark, sf, "benchmark"), "item_id"))


@query
def encoded_pairs(spark, sf):
    rows, toks = _localised(spark, sf), _tokens(spark, sf)
    v = _token_ids(toks)
    return Z.training_rows(rows, "idx", v, most=70, toks=toks).select("idx", "side", F.size("input_ids").alias("n"), F.round(F.aggregate("response_mask", F.lit(0.0), lambda a, x: a + x), 6).alias("mass"))


def _scored(spark, sf) -> DataFrame:
    """Token scores of a policy and a reference that differ in smoothing, counted on chosen traces."""
    t = _tokens(spark, sf)
    counts = L.unigram_counts(t.where("side = 'chosen'"))
    return L.unigram_scores(t, counts, {"policy": 1.0, "ref": 10.0})


@query
def masked_logp(spark, sf):
    s = L.masked_sums(_scored(spark, sf), ["idx", "side"], ["policy", "ref"])
    return s.select("idx", "side", F.round("policy", 6).alias("policy"), F.round("ref", 6).alias("ref"))


@query
def masked_logp_normalised(spark, sf):
    s = L.masked_sums(_scored(spark, sf), ["idx", "side"], ["policy", "ref"], normalised=True)
    return s.select("idx", "side", F.round("policy", 6).alias("policy"), F.round("ref", 6).alias("ref"))


def _preference(spark, sf) -> DataFrame:
    return L.preference_rows(L.masked_sums(_scored(spark, sf), ["idx", "side"], ["policy", "ref"]), ["idx"])


@query
def preference_loss(spark, sf):
    p = _preference(spark, sf)
    return p.select("idx", *[F.round(c, 6).alias(c) for c in ("chosen_reward", "rejected_reward", "reward_margin", "loss")])


@query
def loss_metrics(spark, sf):
    m = L.loss_metrics(_preference(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query
def probe_deltas(spark, sf):
    """Mean masked scores of four probes before and after, one wide row; tokens are scored once."""
    n, m = F.size("rejected_steps"), F.col("first_error_step")
    place = F.transform(F.sequence(F.lit(1), n), lambda k: k.cast("double"))  # weighs a token by its step's place, so that sums by it serve all probes
    rows = _localised(spark, sf).withColumn("step_weights", place).withColumn("key", F.struct("idx", n.alias("n"), m.alias("m")))
    t = J.stored(Z.token_table(rows, "key", places=False), "tokens")
    s = L.unigram_scores(t.where("side = 'rejected'"), L.unigram_counts(t.where("side = 'chosen'")), {"before": 1.0, "after": 10.0})
    steps = L.masked_sums(s.withColumn("step", F.col("w").cast("int")).withColumn("w", F.lit(1.0)), ["key", "step"], ["before", "after"])
    each = steps.groupBy("key").agg(F.collect_list(F.struct("step", "before", "after")).alias("steps"))  # a trace has few steps
    each = each.withColumn("probe", F.explode(F.array(*map(F.lit, S.PROBES)))).withColumn("weights", S.probe_weights(F.col("key.n"), F.col("key.m"), F.col("probe"), 0.5))
    total = lambda c: F.aggregate("steps", F.lit(0.0), lambda a, x: a + x[c] * F.when(x["step"] > 0, F.try_element_at("weights", x["step"])).otherwise(0.0))
    means = each.select("probe", total("before").alias("before"), total("after").alias("after")).groupBy("probe").agg(F.avg("before").alias("before"), F.avg("after").alias("after")).withColumn("variant", F.lit("smoothed"))
    d = L.probe_deltas(means, list(S.PROBES))
    return d.select("variant", *[F.round(c, 6).alias(c) for c in d.columns if c != "variant"])


@query
def rejected_logp_annotation(spark, sf):
    rows = G.template_pairs(_few_seeds(spark, sf)).select("idx", "template")
    out = L.annotate_rejected(rows, L.masked_sums(_scored(spark, sf), ["idx", "side"], ["policy"]), "idx")
    return out.select("idx", "template", F.round("weighted_rejected_logp", 6).alias("weighted_rejected_logp"))


def _neighbours(spark, sf) -> DataFrame:
    """``side, prev, token``: neighbouring tokens of both traces with their prompts, as a table."""
    seq = Z.token_words(_localised(spark, sf))  # one trace
    pair = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("prev"), F.slice("s", F.lit(2), F.size("s")).alias("token"))
    return J.stored(seq.select("side", F.inline(pair).alias("prev", "token")), "pairs")


@query
def bigram_logp(spark, sf):
    """Mean log-probability by side under counts of neighbouring tokens of chosen traces."""
    both = _neighbours(spark, sf)
    base = both.where("side = 'chosen'")
    counts, pairs = base.groupBy(F.col("prev").alias("token")).agg(F.count("*").alias("n")), base.groupBy("prev", "token").agg(F.count("*").alias("n"))
    return L.bigram_scores(both, counts, pairs, 1.0).groupBy("side").agg(F.round(F.avg("logp"), 6).alias("mean_logp"), F.count("*").alias("n"))


@query
def process_positive_metrics(spark, sf):
    """Loss with the process-positive term: prefixes before the error, absent ones counted as 0."""
    rows = _localised(spark, sf)
    prefix = F.when(F.col("first_error_step") >= 1, F.array_join(F.slice("rejected_steps", F.lit(1), F.col("first_error_step")), "\n"))
    t = J.stored(Z.token_table(rows.withColumn("positive_prefix", prefix), "idx", places=False), "tokens")
    counts = L.unigram_counts(t.where("side = 'chosen'"))
    s = L.unigram_scores(t, counts, {"policy": 1.0, "ref": 10.0})
    m = L.loss_metrics(L.preference_rows(L.masked_sums(s, ["idx", "side"], ["policy", "ref"]), ["idx"]), 0.2)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query
def padded_batch(spark, sf):
    """Toy questions as token lengths right-padded to the batch's longest."""
    q = G.toy_questions(_few_seeds(spark, sf)).select("idx", F.transform(K.scan(F.col("question")), lambda t: t["end"] - t["start"]).alias("ids"))
    widest = q.agg(F.max(F.size("ids")).alias("width"))
    return q.crossJoin(F.broadcast(widest)).select("idx", F.array_join(K.padded(F.col("ids"), F.col("width") + 2, 0), ",").alias("ids"))  # one row


@query
def strict_pairing(spark, sf):
    q = G.toy_questions(_few_seeds(spark, sf))
    return P.pair_strictly(q.select("idx", "question"), q.select("idx", F.concat(F.lit("reply "), F.col("answer")).alias("completion")), ["idx"]).select("idx", "completion")


@query
def confident_rates(spark, sf):
    """Localised from rates only, kept from a confidence of 0.6 on."""
    r = _rates(spark, sf).select(F.col("l_orderkey").alias("idx"), F.lit("").alias("prompt"), F.lit("").alias("rejected"), F.lit("1").alias("answer"), F.transform("rates", lambda x: F.lit("a step of text")).alias("rejected_steps"), F.col("rates").alias("prefix_success_rates"))
    z = Z.localise(r, min_confidence=0.6, check=False)
    return z.select("idx", "branch", "first_error_step", F.round("localization_confidence", 6).alias("confidence"))


@query
def short_traces_dropped(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("rejected"))
    return Z.with_steps(c, least=2).select("conv_id", "turn", F.size("rejected_steps").alias("n_steps"))


@query
def judged_pairs(spark, sf):
    p = _pairs(spark, sf)
    reply = F.when(F.col("idx") % 6 == 5, F.lit("no idea")).otherwise(F.concat(F.lit('{"first_error_step": '), (F.col("idx") % 4).cast("string"), F.lit(', "confidence": 0.75, "rationale": "x"}')))
    z = Z.judged(p.select("idx", "rejected", "rejected_steps", reply.alias("reply")))
    return z.select("idx", "first_error_step", "localization_confidence", "judge_rationale", "parse_failed", _joined("step_weights").alias("weights"))


@query
def cached_localisations(spark, sf):
    rows = _few_seeds(spark, sf).select(F.col("idx").alias("sample_id"))
    return P.cache_misses(rows, rows.where(F.col("sample_id") % 3 == 0))


@query
def judge_failures(spark, sf):
    """Rows a judge could not place: every tenth has no text, every sixth reply says nothing."""
    p = _pairs(spark, sf).select("idx", F.when(F.col("idx") % 10 == 0, "").otherwise(F.lit("one step is here. another one follows")).alias("rejected"))
    return Z.judge_failures(p.withColumn("reply", F.when(F.col("idx") % 6 == 5, F.lit("no idea")).otherwise(F.lit('{"first_error_step": 0}'))))


@query
def model_grid(spark, sf):
    """Every toy question for each of three models, scored and summed up."""
    q = R.grid(G.toy_questions(_few_seeds(spark, sf)).select("idx", F.col("question").alias("prompt"), F.col("answer").alias("gold")), ["always", "thirds", "never"])
    right = (F.col("model") == "always") | ((F.col("model") == "thirds") & (F.col("idx") % 3 == 0))
    said = q.withColumn("prediction", F.when(right, F.col("gold")).otherwise(F.lit("#### -1")))
    a = R.accuracy(R.generation_details(said))
    return a.select("model", F.round("accuracy", 6).alias("accuracy"), "correct", "total")


# Files


@query
def jsonl_round_trip(spark, sf):
    """Pair records written as JSON Lines and read again, nulls and other alphabets included."""
    q = G.placeholder_pairs(G.toy_questions(_few_seeds(spark, sf)))
    note = F.concat(F.lit('naïve ✓ "'), F.col("idx").cast("string"), F.lit('"'))
    rows = q.withColumn("answer", F.when(F.col("idx") % 2 == 0, F.col("answer"))).withColumn("metadata", as_metadata(note=note))
    path = J.shared_path(spark, "pairs")
    J.write_jsonl(as_pairs(rows), path)
    return J.read_jsonl(spark, path, J.PAIR).select("prompt", "chosen", "rejected", "answer", F.try_variant_get("metadata", "$.note", "string").alias("note"))


@query
def typed_metadata(spark, sf):
    """Metadata of several types written as JSON Lines, read, merged with a job's own, written and read again."""
    q = G.placeholder_pairs(G.toy_questions(_few_seeds(spark, sf)))
    i = F.col("idx")
    nested = F.struct(F.array(i, i + 1).alias("rows"), F.struct(F.lit("é").alias("name"), F.lit(None).cast("string").alias("note")).alias("by"))
    meta = as_metadata(row_id=i, ok=i % 2 == 0, x=(i + 0.5).cast("decimal(20,1)"), none=F.lit(None).cast("string"), text=i.cast("string"), nested=nested)
    once, twice = J.shared_path(spark, "typed"), J.shared_path(spark, "typed")
    J.write_jsonl(as_pairs(q.withColumn("metadata", meta)), once)
    read = J.read_jsonl(spark, once, J.PAIR)
    J.write_jsonl(read.withColumn("metadata", merge_metadata(F.col("metadata"), as_metadata(text=F.lit(7), gamma=F.lit(0.25)))), twice)
    m = lambda name, kind: F.try_variant_get("metadata", f"$.{name}", kind)
    back = J.read_jsonl(spark, twice, J.PAIR)
    return back.select(m("row_id", "bigint").alias("row_id"), F.to_json("metadata").alias("metadata"), F.schema_of_variant(m("x", "variant")).startswith("DECIMAL").alias("x_is_decimal"), F.schema_of_variant(m("none", "variant")).alias("none_is"))


@query
def record_positions(spark, sf):
    """Consecutive positions of JSON Lines records over several files."""
    rows, path = _seeds(spark, sf).select("idx"), J.shared_path(spark, "numbered-pairs")
    J.write_jsonl(rows.repartitionByRange(5, "idx").sortWithinPartitions("idx"), path)
    return J.read_jsonl(spark, path, rows.schema, ordinal="row_id")


@query
def variant_files(spark, sf):
    """Weight variants fanned out to a folder each, read again by ``name=path`` arguments."""
    rows = P.weight_variants(_pairs(spark, sf).select("idx", "rejected_steps", "first_error_step"))
    path = J.shared_path(spark, "variants")
    J.write_jsonl(rows.select("idx", "weight_variant", "step_weights"), path, by="weight_variant")
    schema = rows.select("idx", "step_weights").schema
    named = P.parse_named_paths([f"{v}={path}/weight_variant={v}" for v in S.VARIANTS])
    each = [J.read_jsonl(spark, at, schema).withColumn("weight_variant", F.lit(v)) for v, at in named.items()]
    return reduce(DataFrame.unionByName, each).select("idx", "weight_variant", _joined("step_weights", 4).alias("weights"))


@query
def resumed_rows(spark, sf):
    """A run that stopped after a third of its rows and was started again adds only the others."""
    rows, path = _few_seeds(spark, sf).select("idx"), J.shared_path(spark, "resumed")
    J.append_missing(rows.where(F.col("idx") % 3 == 0).withColumn("run", F.lit("first")), path, "idx")
    J.append_missing(rows.withColumn("run", F.lit("second")), path, "idx")
    return J.read_jsonl(spark, path, T.StructType([rows.schema["idx"], T.StructField("run", T.StringType())]))


@query
def csv_report(spark, sf):
    """Accuracy of each template as a CSV report, read again as text."""
    p = _pairs(spark, sf)
    d = p.select("template", verify_answer(F.when(F.col("idx") % 4 == 0, F.col("chosen")).otherwise(F.col("rejected")), F.col("answer")).alias("correct"))
    path = J.shared_path(spark, "report")
    J.write_report(R.accuracy(d, by="template"), path)
    return spark.read.option("header", True).csv(path).select("template", "accuracy", "total")


@query
def committed_increments(spark, sf):
    """Two increments with repeated keys, the first of them run twice: each key once, by the first that brings it."""
    rows = _few_seeds(spark, sf).select("idx")
    table = J.Increments(spark, J.shared_path(spark, "increments"), T.StructType([rows.schema["idx"], T.StructField("run", T.StringType())]), "idx")
    third = rows.where(F.col("idx") % 3 == 0)
    table.append("first", third.unionByName(third).withColumn("run", F.lit("first")))
    table.append("first", rows.withColumn("run", F.lit("again")))
    table.append("second", rows.unionByName(rows).withColumn("run", F.lit("second")))
    return table.rows()


@query
def seeded_draws(spark, sf):
    """A seed for each customer, by hash of the key."""
    return G.drawn_seeds(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "seed")


@query
def cached_completions(spark, sf):
    """Two samples of each toy question from a cache that a first run over a third of them began."""
    q = V.ask(G.toy_questions(_few_seeds(spark, sf)).select("idx", F.col("question").alias("prompt")), 2)
    path, provider = J.shared_path(spark, "completions"), lambda prompts: [(f"{len(p)} characters", None) for p in prompts]
    V.cached(q.where(F.col("idx") % 3 == 0), lambda prompts: [("kept", None)] * len(prompts), path)
    return V.cached(q, provider, path).select("idx", "sample_no", "completion")


# Order, ranges, logits, streams


@query
def length_batches(spark, sf):
    """Toy questions in batches of 16 like lengths, each padded to its own longest."""
    q = G.toy_questions(_few_seeds(spark, sf)).select("idx", F.transform(K.scan(F.col("question")), lambda t: t["end"] - t["start"]).alias("ids"))
    q = q.withColumn("ids", F.slice("ids", F.lit(1), (F.col("idx") % 9 + 12).cast("int")))
    b = O.padded_batches(q, "ids", "idx", 16)
    return b.select("idx", "batch", "place", "width", F.array_join("ids", ",").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


@query
def training_batches(spark, sf):
    """Encoded sides of localised pairs, whole, in batches of 8 like lengths, masks padded with them."""
    rows, toks = _localised(spark, sf), _tokens(spark, sf)
    v = _token_ids(toks)
    b = O.padded_batches(Z.training_rows(rows, "idx", v, most=None, toks=toks).drop("attention_mask"), "input_ids", ["idx", "side"], 8, also={"response_mask": 0.0})
    total = lambda c, zero: F.aggregate(c, F.lit(zero), lambda a, x: a + x)
    return b.select("idx", "side", "batch", "place", "width", F.size("input_ids").alias("n_ids"), F.size("response_mask").alias("n_mask"), total("attention_mask", 0).alias("n_real"), F.round(total("response_mask", 0.0), 6).alias("mass"))


@query
def cyclic_batches(spark, sf):
    """Steps 10 to 509 of batches of 7 customers, in the order of their keys, round and round."""
    return O.cyclic_batches(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 500, 7, start=10).select("step", "place", "c_custkey")


@query
def token_weights_joined(spark, sf):
    """Weights of rejected tokens by a range join of tokens and step spans."""
    rows = _localised(spark, sf)
    toks = rows.select("idx", F.posexplode(K.scan(F.col("rejected"))).alias("pos", "t")).select("idx", "pos", "t.token", "t.start", "t.end")
    spans = rows.select("idx", "step_weights", F.posexplode(step_spans(F.col("rejected"), F.col("rejected_steps"))).alias("k", "s"))
    spans = spans.select("idx", "k", "s.start", "s.end", F.try_element_at("step_weights", F.col("k") + 1).alias("w"))
    return I.weights_by_span(toks, spans, ["idx"], 32).select("idx", "pos", "token", F.round("w", 6).alias("w"))


@query
def softmax_logp(spark, sf):
    """Label scores from logits of eleven tokens at six places of each customer, some of them very large."""
    c = _few_seeds(spark, sf).select("idx", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    labels = c.select("idx", "pos", ((F.col("idx") * 7 + F.col("pos") * 3) % 11).alias("token_id"))
    each = c.withColumn("token_id", F.explode(F.expr("sequence(0L, 10L)")))
    logit = (F.col("idx") * 31 + F.col("pos") * 17 + F.col("token_id") * 13) % 97 / 8 + F.when(F.col("idx") % 3 == 0, 800.0).otherwise(0.0)
    got = L.gathered_logps(each.withColumn("logit", logit), labels, ["idx"])
    return got.select("idx", "pos", F.round("logp", 6).alias("logp"), F.round("mass", 6).alias("mass"))


@query
def backoff_logp(spark, sf):
    """Mean log-probability by side under interpolated back-off from pairs of chosen traces."""
    both = _neighbours(spark, sf)
    return L.BackOff(both.where("side = 'chosen'").select("prev", "token")).score(both).groupBy("side").agg(F.round(F.avg("logp"), 6).alias("mean_logp"), F.count("*").alias("n"))


@query
def arriving_rates(spark, sf):
    """Rates of order lines that arrive in disorder over four batches, localised by a stream with keyed state."""
    r = _rates(spark, sf)
    e = r.select("l_orderkey", F.size("rates").alias("n"), F.posexplode("rates").alias("k", "rate"))
    path = J.shared_path(spark, "arriving")
    e.repartition(4, F.md5(F.concat_ws(":", "l_orderkey", "k"))).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    z = streaming.localise_arriving(stream, "l_orderkey").drop("n")
    z.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out", "parquet").awaitTermination()
    return spark.read.schema(z.schema).parquet(f"{path}/out").select("l_orderkey", "first_error", F.round("confidence", 6).alias("confidence"))


@query
def step_spans_not_found(spark, sf):
    """Spans of steps whose white space differs from the text's, or that are not in it."""
    n = F.col("idx").cast("string")
    text = F.concat(F.lit("First  take "), n, F.lit(".\nThen add one. End"))
    steps = F.array(F.concat(F.lit("First take "), n, F.lit(".")), F.lit("Then add one."), F.lit("nowhere"))
    return _few_seeds(spark, sf).select("idx", F.posexplode(step_spans(text, steps)).alias("k", "s")).select("idx", "k", "s.start", F.col("s.end").alias("end_"))
