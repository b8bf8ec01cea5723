"""Success rates, accuracies and judge verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.text import extract_answer, float_value, let, strip, verify_answer


def success_rates(rollouts: DataFrame, by: str, step: str, ok: str) -> DataFrame:
    """``by, rates``: the share of verified completions after each step, in step order."""
    q = rollouts.groupBy(by, step).agg(F.avg(F.coalesce(F.col(ok), F.lit(False)).cast("double")).alias("q"))
    return q.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("k"), "q"))).alias("x")).select(by, F.transform("x", lambda e: e["q"]).alias("rates"))


def generation_details(rows: DataFrame) -> DataFrame:
    """Predicted answers and verdicts of ``rows(model, idx, prompt, gold, prediction)``."""
    return rows.select("model", "idx", "prompt", "gold", "prediction", extract_answer(F.col("prediction")).alias("pred_answer"), verify_answer(F.col("prediction"), F.col("gold")).alias("correct"))


def accuracy(details: DataFrame, models: DataFrame | None = None, by: str = "model") -> DataFrame:
    """``by, accuracy, correct, total``; models without rows get zeros."""
    got = details.groupBy(by).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    if models is not None:
        got = models.select(by).distinct().join(got, by, "left").fillna(0, ["correct", "total"])
    return got.select(by, (F.col("correct") / F.greatest(F.lit(1), F.col("total"))).alias("accuracy"), "correct", "total")


def over_seeds(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and population standard deviation over seeds."""
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


#: Fixed wording of failures; the reason follows the prefix.
FAILED, NO_OBJECT, NOT_JSON = "parse_failed: ", "judge response did not contain a JSON object", "invalid JSON"
NO_FLOAT, NO_NUMBER = "could not convert string to float: ", "float() argument must be a string or a real number, not "
_INTEGER = r"^[+-]?\d+(_\d+)*$"


def parse_verdict(reply: Column, n: Column) -> Column:
    """``struct<first_error, confidence, rationale, failed>`` from a judge's free text.

    The text from the first ``{`` to the last ``}`` is read as JSON.  The index is a number, cut to its
    whole part, or text that spells a whole number; anything else means the last step.  A confidence
    that is there must be a number or spell one, else the reply has failed; so has one without readable
    JSON.  A failed reply is the last step with confidence 0, its rationale the reason.  Indices and
    confidences are clamped, rationales stripped.
    """
    clamp = lambda x, lo, hi: F.greatest(lo, F.least(x, hi))
    number = lambda v: v["kind"].rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")

    def read(doc, name):  # null kind: the field is not there
        facts = lambda v: F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"), F.try_variant_get(v, "$", "double").alias("value"))
        return let(F.try_variant_get(doc, f"$.{name}", "variant"), facts).alias(name)

    def parts(x):
        at, sure, why = x["first_error_step"], x["confidence"], x["rationale"]
        spelt = strip(at["text"])
        index = F.when(at["kind"] == "BOOLEAN", (at["text"] == "true").cast("double")).when(number(at), F.floor(at["value"]).cast("double"))
        index = index.when((at["kind"] == "STRING") & spelt.rlike(_INTEGER), F.replace(spelt, F.lit("_"), F.lit("")).try_cast("double"))
        c = F.when(sure["kind"] == "BOOLEAN", (sure["text"] == "true").cast("double")).when(number(sure), sure["value"])
        c = c.when(sure["kind"] == "STRING", float_value(strip(sure["text"]))).when(sure["kind"].isNull(), F.lit(0.0))
        r = F.when(why["kind"] == "VOID", "None").when(why["kind"] == "BOOLEAN", F.initcap(why["text"])).otherwise(strip(F.coalesce(why["text"], F.lit(""))))
        return F.struct(x["lost"].alias("lost"), sure["kind"].alias("kind"), sure["text"].alias("text"), index.alias("i"), F.when(F.isnan(c), 0.0).otherwise(c).alias("c"), r.alias("r"))

    def fields(found):
        lost = lambda doc: F.when(found.isNull(), NO_OBJECT).when(doc.isNull(), NOT_JSON)
        return let(F.try_parse_json(found), lambda doc: F.struct(lost(doc).alias("lost"), *[read(doc, x) for x in ("first_error_step", "confidence", "rationale")]))

    def verdict(v):
        named = F.when(v["kind"] == "VOID", "'NoneType'").when(v["kind"].startswith("ARRAY"), "'list'").otherwise("'dict'")
        no_float = F.when(v["kind"] == "STRING", F.concat(F.lit(NO_FLOAT + "'"), v["text"], F.lit("'"))).otherwise(F.concat(F.lit(NO_NUMBER), named))
        return let(F.struct(v.alias("v"), F.coalesce(v["lost"], F.when(v["c"].isNull(), no_float)).alias("why")), outcome)

    def outcome(z):
        v, why, last = z["v"], z["why"], n - 1
        index = clamp(F.coalesce(v["i"], last.cast("double")), F.lit(0.0), last.cast("double"))
        return F.struct(
            F.when(why.isNotNull(), last).otherwise(index).cast("int").alias("first_error"),
            F.when(why.isNotNull(), 0.0).otherwise(clamp(v["c"], F.lit(0.0), F.lit(1.0))).alias("confidence"),
            F.when(why.isNotNull(), F.concat(F.lit(FAILED), why)).otherwise(v["r"]).alias("rationale"),
            why.isNotNull().alias("failed"),
        )

    found = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return let(let(let(found, fields), parts), verdict)


def grid(questions: DataFrame, models: list[str]) -> DataFrame:
    """Every question for every model, as rows with ``model``; the questions are not shuffled."""
    return questions.withColumn("model", F.explode(F.array(*map(F.lit, models)) if models else F.array().cast("array<string>")))
