"""The localisation cascade and the training-row export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.functions import steps as S
from stepwright.functions import tokens as K
from stepwright.functions.segment import segment_steps, step_spans
from stepwright.functions.text import let
from stepwright.operators.reports import parse_verdict
from stepwright.operators.scores import lookup


def with_steps(rows: DataFrame, text: str = "rejected", steps: str = "rejected_steps", least: int = 1) -> DataFrame:
    """Steps that are there are kept, else the text is segmented; rows with fewer than ``least`` go."""
    made = segment_steps(F.col(text))
    have = F.when(F.size(steps) > 0, F.col(steps)) if steps in rows.columns else F.lit(None).cast("array<string>")
    out = rows.withColumn(steps, F.coalesce(have, made, F.array().cast("array<string>")))
    return out.where(F.size(steps) >= least) if least > 0 else out


def localise(rows: DataFrame, gamma: float = 0.5, tau: float = 0.3, min_confidence: float = 0.0, check: bool = True, short: bool = False) -> DataFrame:
    """First error, confidence, weights and ``branch`` of every row; the first source that has an answer wins.

    In order: a wrong equation (confidence 1), given prefix success rates, a given label, rates by the
    verifier alone.  The confidence filter binds rows localised from rates only.  One projection chain
    without a shuffle; rows that want rollouts get their rates from ``reports.success_rates`` first.
    """
    rows = with_steps(rows, least=2 if short else 0)
    have = set(rows.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    steps, answer = F.col("rejected_steps"), F.col("answer")
    found = S.arithmetic_error(F.col("prompt"), steps) if check else F.lit(None).cast("int")
    none = F.lit(None).cast("array<double>")
    result = lambda branch, m, sure, rates, width: F.struct(F.lit(branch).alias("branch"), m.cast("int").alias("m"), sure.cast("double").alias("sure"), rates.alias("rates"), width.alias("n"))
    rated = lambda branch, rates: let(S.localize(rates, tau), lambda z: result(branch, z["first_error"], z["confidence"], z["rates"], F.size(z["rates"])))
    given, label = col("prefix_success_rates", "array<double>"), col("first_error_step", "int")
    labelled = result("label", label, F.coalesce(col("localization_confidence", "double"), F.lit(1.0)), none, F.size(steps))
    guessed = rated("heuristic", S.heuristic_rates(steps, answer))

    def choose(m):
        exact = result("arithmetic", m, F.lit(1.0), F.array().cast("array<double>"), F.size(steps))
        return F.when(m.isNotNull(), exact).when(given.isNotNull(), rated("rates", given)).when(label.isNotNull(), labelled).otherwise(guessed)

    x = rows.withColumn("_z", let(found, choose))
    drop = [c for c in ("first_error_step", "localization_confidence", "prefix_success_rates", "step_weights", "branch") if c in have]
    x = x.drop(*drop).select("*", F.col("_z.branch").alias("branch"), F.col("_z.m").alias("first_error_step"), F.col("_z.sure").alias("localization_confidence"), F.col("_z.rates").alias("prefix_success_rates"), S.decayed(F.col("_z.n"), F.col("_z.m"), gamma).alias("step_weights"))
    if min_confidence <= 0:  # confidences are never negative
        return x.drop("_z")
    sure_enough = F.col("branch").isin("arithmetic", "label") | (F.col("localization_confidence") >= min_confidence)
    return x.where(sure_enough).drop("_z")


def judged(rows: DataFrame, reply: str = "reply", gamma: float = 0.25) -> DataFrame:
    """Rows localised by a judge's replies; rows without steps go, failed replies mean the last step."""
    x = with_steps(rows, least=1).withColumn("_v", parse_verdict(F.col(reply), F.size("rejected_steps")))
    x = x.withColumn("first_error_step", F.col("_v.first_error")).withColumn("localization_confidence", F.col("_v.confidence")).withColumn("judge_rationale", F.col("_v.rationale")).withColumn("parse_failed", F.col("_v.failed"))
    return x.withColumn("step_weights", S.decayed(F.size("rejected_steps"), F.col("first_error_step"), gamma)).drop("_v")


def judge_failures(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """One row: ``total, no_steps, parse_failed, failures`` of rows given to a judge; the last counts both kinds."""
    x = with_steps(rows, least=0)
    empty = F.size("rejected_steps") == 0
    bad = ~empty & parse_verdict(F.col(reply), F.size("rejected_steps"))["failed"]
    one = x.agg(F.count("*").alias("total"), F.count_if(empty).alias("no_steps"), F.count_if(bad).alias("parse_failed"))
    return one.withColumn("failures", F.col("no_steps") + F.col("parse_failed"))


def token_lists(rows: DataFrame, key: str, only: tuple[str, ...] = (), places: bool = True) -> DataFrame:
    """``key, side, toks``: each side's tokens as an array of ``struct<token, start, end, w>``, or of the sides ``only``; a row's prompt is scanned once.

    Prompt tokens weigh 0, chosen and positive tokens 1, rejected ones their step's weight unless the row
    brings ``rejected_token_weights``.  Without ``places`` start and end are left out and not computed where no weight needs them.
    """
    have = set(rows.columns)
    weigh = lambda t, w: F.struct(t["token"].alias("token"), *([t["start"].alias("start"), t["end"].alias("end")] if places else []), w.alias("w"))
    alike = lambda c, w: F.transform(K.scan(c), lambda t: weigh(t, F.lit(w))) if places else F.transform(K.words(c), lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))
    rows = rows.withColumn("_prompt", alike(F.col("prompt"), 0.0))
    prompt = F.col("_prompt")
    given = F.col("rejected_token_weights") if "rejected_token_weights" in have else F.lit(None).cast("array<double>")

    def weighed(toks):
        own = F.coalesce(given, K.token_weights(toks, step_spans(F.col("rejected"), F.col("rejected_steps")), F.col("step_weights")))
        return F.zip_with(toks, own, weigh)

    rejected = let(K.scan(F.col("rejected")), weighed)
    sides = [("chosen", F.concat(prompt, alike(F.col("chosen"), 1.0))), ("rejected", F.concat(prompt, rejected))]
    if "positive_prefix" in have:
        empty = F.array().cast(f"array<struct<token:string,{'start:int,end:int,' if places else ''}w:double>>")
        sides.append(("positive", F.when(F.coalesce(F.col("positive_prefix"), F.lit("")) == "", empty).otherwise(F.concat(prompt, alike(F.col("positive_prefix"), 1.0)))))
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), t.alias("toks")) for s, t in sides if not only or s in only])).alias("s"))
    return each.select(key, "s.side", "s.toks")


def token_words(rows: DataFrame) -> DataFrame:
    """``side, s``: the tokens alone of each row's chosen and rejected sequence; nothing is placed or weighed."""
    prompt = rows.select(K.words(F.col("prompt")).alias("_prompt"), "chosen", "rejected")
    side = lambda name: F.struct(F.lit(name).alias("side"), F.concat("_prompt", K.words(F.col(name))).alias("s"))
    return prompt.select(F.explode(F.array(side("chosen"), side("rejected"))).alias("t")).select("t.*")


def token_table(rows: DataFrame, key: str, only: tuple[str, ...] = (), places: bool = True) -> DataFrame:
    """``key, side, pos, token, start, end, w``: the tokens of ``token_lists`` a row each, in sequence order."""
    return token_lists(rows, key, only, places).select(key, "side", F.posexplode("toks").alias("pos", "t")).select(key, "side", "pos", "t.*")


def training_rows(rows: DataFrame, key: str, vocabulary: DataFrame, most: int | None = 768, toks: DataFrame | None = None) -> DataFrame:
    """``key, side, input_ids, attention_mask, response_mask`` ready for a trainer, cut to ``most`` tokens, or whole if that is None.

    ``toks`` may bring the rows' token table where it is there already.
    """
    toks = token_table(rows, key) if toks is None else toks
    toks = (toks if most is None else toks.where(F.col("pos") < most)).join(lookup(vocabulary.select("token", "token_id")), "token", "left")
    one = F.struct("pos", F.coalesce("token_id", F.lit(2)).alias("id"), "w")
    seq = toks.groupBy(key, "side").agg(F.sort_array(F.collect_list(one)).alias("s"))  # one sequence
    return seq.select(key, "side", F.transform("s", lambda x: x["id"]).alias("input_ids"), F.transform("s", lambda x: F.lit(1)).alias("attention_mask"), F.transform("s", lambda x: x["w"]).alias("response_mask"))
