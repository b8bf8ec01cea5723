"""Pairs from candidates, and their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions import steps as S
from stepwright.functions.text import strip, verify_answer
from stepwright.sources.jsonl import as_metadata, merge_metadata

from . import order as O


def select_pairs(candidates: DataFrame, by: list[str], text: str, order: str, ok: str, gold: str) -> DataFrame:
    """For each prompt the first right and first wrong candidate, in one aggregation.

    Without a right one the gold text is chosen; prompts without a wrong one are left out.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    first = lambda cond: F.min(F.when(cond, F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))["t"]
    got = candidates.groupBy(*by).agg(first(good).alias("right"), first(~good).alias("rejected"), F.count("*").alias("num_candidates"), F.count_if(good).alias("n_right"), F.min(gold).alias("gold"))
    return got.where(F.col("num_candidates") > F.col("n_right")).select(*by, F.when(F.col("n_right") > 0, F.col("right")).otherwise(F.col("gold")).alias("chosen"), "rejected", "num_candidates", (F.col("n_right") > 0).alias("has_sampled_chosen"))


def repair_elicited(rows: DataFrame) -> DataFrame:
    """Drop rows whose rejected text is right after all; a wrong chosen text becomes a canned one."""
    n = F.split_part(F.split_part("question", F.lit(" has "), F.lit(2)), F.lit(" packs"), F.lit(1))
    canned = F.concat(F.lit("There are "), n, F.lit(" packs. Compute directly. "), F.col("answer"))
    chosen = F.when(verify_answer(F.col("chosen"), F.col("answer")), F.col("chosen")).otherwise(canned)
    return rows.where(~verify_answer(F.col("rejected"), F.col("answer"))).withColumn("chosen", chosen)


def weight_variants(rows: DataFrame, gamma: float = 0.5, uniform: float = 0.25) -> DataFrame:
    """A row for each weight variant, exploded in place: no join, no shuffle."""
    out = rows.withColumn("weight_variant", F.explode(F.array(*map(F.lit, S.VARIANTS))))
    w = S.variant_weights(F.size("rejected_steps"), F.col("first_error_step"), F.col("weight_variant"), gamma, uniform)
    out = out.withColumn("step_weights", w)
    if "metadata" in rows.columns:
        base = as_metadata(weight_variant=F.col("weight_variant"), gamma=F.lit(gamma))
        full = as_metadata(weight_variant=F.col("weight_variant"), gamma=F.lit(gamma), uniform_weight=F.lit(uniform))
        out = out.withColumn("metadata", merge_metadata(F.col("metadata"), F.when(F.col("weight_variant") == "uniform_downweight", full).otherwise(base)))
    return out


def _gamma(rows: DataFrame, default: float = 0.25) -> Column:
    return F.coalesce(F.try_variant_get("metadata", "$.gamma", "double"), F.lit(default)) if "metadata" in rows.columns else F.lit(default)


def _relabel(rows: DataFrame, error: Column, name: str, **more: Column) -> DataFrame:
    """A new first error with weights and an audit trail in the metadata."""
    old = rows.withColumn("_old", F.col("first_error_step")).withColumn("first_error_step", error.cast("int"))
    out = old.withColumn("step_weights", S.decayed(F.size("rejected_steps"), F.col("first_error_step"), _gamma(rows), clamp=False))
    if "metadata" in rows.columns:
        trail = as_metadata(reviewer_variant=F.lit(name), original_first_error_step=F.col("_old"), shifted_first_error_step=F.col("first_error_step"), **more)
        out = out.withColumn("metadata", merge_metadata(F.col("metadata"), trail))
    return out.drop("_old")


def shift_error(rows: DataFrame, by: int) -> DataFrame:
    return _relabel(rows, S.shifted(F.col("first_error_step"), F.size("rejected_steps"), by), f"shift_error_{by:+d}")


def noise_error(rows: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    drawn = rows.withColumn("_noise", S.noisy(F.col(key), F.col("first_error_step"), F.size("rejected_steps"), rate, seed))
    return _relabel(drawn, F.col("_noise.error"), f"random_error_noise_{rate:.2f}", localization_noisy=F.col("_noise.noisy")).withColumn("localization_noisy", F.col("_noise.noisy")).drop("_noise")


def truncate_rejected(rows: DataFrame) -> DataFrame:
    """The rejected trace through its first error, every step with weight 1."""
    m, n = F.col("first_error_step"), F.size("rejected_steps")
    out = rows.withColumn("_n", n).withColumn("_m", m).withColumn("rejected_steps", F.slice("rejected_steps", F.lit(1), F.greatest(F.lit(0), m + 1)))
    out = out.withColumn("rejected", F.array_join("rejected_steps", "\n")).withColumn("first_error_step", F.size("rejected_steps") - 1).withColumn("step_weights", F.array_repeat(F.lit(1.0), F.size("rejected_steps")))
    if "metadata" in rows.columns:
        trail = as_metadata(reviewer_variant=F.lit("truncated_rejected_through_first_error"), original_num_rejected_steps=F.col("_n"), original_first_error_step=F.col("_m"))
        out = out.withColumn("metadata", merge_metadata(F.col("metadata"), trail))
    return out.drop("_n", "_m")


def positive_prefix(rows: DataFrame, least: int = 1) -> DataFrame:
    """Rows with at least ``least`` steps before the error, and those steps as a positive text."""
    m = F.col("first_error_step")
    out = rows.where(m >= least).withColumn("positive_prefix", strip(F.array_join(F.slice("rejected_steps", F.lit(1), F.greatest(F.lit(0), m)), "\n")))
    if "metadata" in rows.columns:
        out = out.withColumn("metadata", merge_metadata(F.col("metadata"), as_metadata(process_positive=F.lit(True), positive_prefix_steps=m)))
    return out


def split_exact(rows: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly ``round(n * ratio)`` rows train, at least one row on either side if n > 1.

    Ranks come from counts by hash prefix, so no task sees all rows: only the one prefix bucket in which
    the cut falls is ordered.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must be in (0, 1)")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    bits = rows.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = {r[0]: r[1] for r in bits.groupBy("_b").count().collect()}  # 4,096 rows at most
    n = sum(counts.values())
    if n == 0:
        raise ValueError("no rows to split")
    cut = max(1, min(n - 1, round(n * ratio)))
    below, at = 0, 4096
    for b in sorted(counts):
        if below + counts[b] > cut:
            at = b
            break
        below += counts[b]
    from pyspark.sql import Window as W

    left = cut - below
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", F.col(key)))
    inside = bits.where(F.col("_b") == at).withColumn("split", F.when(rank <= left, "train").otherwise("test"))
    rest = bits.where(F.col("_b") != at).withColumn("split", F.when(F.col("_b") < at, "train").otherwise("test"))
    return rest.unionByName(inside).drop("_h", "_b")


def vocabulary(texts: DataFrame, order: str, text: str = "text", reserved: tuple[str, ...] = ("<pad>", "<eos>", "<unk>")) -> DataFrame:
    """``token, first_row, first_pos``: distinct tokens with their first place, the order of ids.

    ``vocabulary_ids`` numbers them in that order.
    """
    from stepwright.functions.text import WS

    words = texts.select(F.col(order).alias("row"), F.posexplode(F.regexp_extract_all(text, F.lit(rf"(?U)[^\s\x1c-\x1f]+"), F.lit(0))).alias("pos", "token"))
    first = words.groupBy("token").agg(F.min(F.struct("row", "pos")).alias("at"))
    return first.where(~F.col("token").isin(*reserved)).select("token", F.col("at.row").alias("first_row"), F.col("at.pos").alias("first_pos"))


def vocabulary_ids(vocab: DataFrame, start: int = 3) -> DataFrame:
    """Adds ``token_id``: consecutive numbers in the order of first places, without a task that sees all tokens."""
    return O.numbered(vocab, ["first_row", "first_pos"], "token_id", start).withColumn("token_id", F.col("token_id").cast("int"))


def pair_strictly(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows matched one to one; a key that one side lacks or repeats raises when the row is computed.

    One outer join on counted keys: no extra pass over either side.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*on)
    a = left.withColumn("_a", F.count("*").over(w))
    b = right.withColumn("_b", F.count("*").over(w))
    both = a.join(b, on, "full")
    right_count = (F.coalesce("_a", F.lit(0)) == 1) & (F.coalesce("_b", F.lit(0)) == 1)
    return both.where(F.when(right_count, True).otherwise(F.raise_error(F.lit("sides differ in rows")).cast("boolean"))).drop("_a", "_b")


def parse_named_paths(args: list[str]) -> dict[str, str]:
    """``name=path`` arguments, split at the first ``=``; others raise."""
    out = {}
    for a in args:
        name, mark, path = a.partition("=")
        if not mark:
            raise ValueError(f"expected name=path: {a}")
        out[name] = path
    return out


def cache_misses(rows: DataFrame, cache: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose key a localisation cache does not hold yet."""
    return rows.join(cache.select(key), key, "left_anti")
