"""Token scores: count-based scorers, masked sums, preference loss and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.sources.jsonl import stored

#: Counts of at most so many rows are broadcast to the tokens; more are joined by shuffles.
LOOKUP_ROWS = 1 << 17


def lookup(counts: DataFrame) -> DataFrame:
    """Counts as a table that token rows are joined with: broadcast if it is small, so that tokens, most of them very frequent ones, stay where they are."""
    own = stored(counts, "counts")
    return F.broadcast(own) if own.count() <= LOOKUP_ROWS else own.hint("merge")


def unigram_counts(tokens: DataFrame) -> DataFrame:
    """``token, n`` of a token table."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def unigram_scores(tokens: DataFrame, counts: DataFrame, smoothing: dict[str, float]) -> DataFrame:
    """Adds the log-probability of each token by its smoothed share, a column for each smoothing.

    Unseen tokens share one extra place.  Counts are joined once, whatever the number of columns.
    """
    counts = lookup(counts)
    total = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_kinds"))
    out = tokens.join(counts.withColumnRenamed("n", "_n"), "token", "left").crossJoin(F.broadcast(total))  # one row
    p = lambda s: (F.coalesce("_n", F.lit(0)) + s) / (F.coalesce("_total", F.lit(0)) + s * (F.col("_kinds") + 1))
    return out.withColumns({name: F.log(p(s)) for name, s in smoothing.items()}).drop("_n", "_total", "_kinds")


def bigram_scores(tokens: DataFrame, counts: DataFrame, pairs: DataFrame, smoothing: float, name: str = "logp") -> DataFrame:
    """Adds log P(token | token before) from ``pairs(prev, token, n)``; ``prev`` must be in ``tokens``."""
    kinds = counts.agg(F.count("*").alias("_kinds"))
    known = lookup(pairs.withColumnRenamed("n", "_n"))
    before = lookup(counts.select(F.col("token").alias("prev"), F.col("n").alias("_before")))
    out = tokens.join(known, ["prev", "token"], "left").join(before, "prev", "left").crossJoin(F.broadcast(kinds))  # one row
    p = (F.coalesce("_n", F.lit(0)) + smoothing) / (F.coalesce("_before", F.lit(0)) + smoothing * (F.col("_kinds") + 1))
    return out.withColumn(name, F.log(p)).drop("_n", "_before", "_kinds")


def log_softmax(logits: DataFrame, by: list[str], logit: str = "logit") -> DataFrame:
    """``logits(by, token_id, logit)`` with ``logp``: each logit less the log of the summed exponentials of its ``by``.

    The greatest logit is taken out of the sum first, so that nothing overflows.  Both sums are over windows of
    one partitioning: logits move once, and a window has a vocabulary's rows at most.
    """
    w = Window.partitionBy(*by)
    own = logits.withColumn("_top", F.max(logit).over(w))
    return own.withColumn("logp", F.col(logit) - F.col("_top") - F.log(F.sum(F.exp(F.col(logit) - F.col("_top"))).over(w))).drop("_top")


def gathered_logps(logits: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """``by, pos, logp, mass`` of ``labels(by, pos, token_id)`` under ``logits(by, pos, token_id, logit)``.

    Logits at a position speak of the token after it, so a label takes its score from the position before
    and the first one has none.  Sums, score and ``mass`` (of all probabilities, 1 but for rounding) of a position come from one
    grouping: labels ride along with the logits of their position and nothing is joined.
    """
    top = F.max("logit").over(Window.partitionBy(*by, "pos"))
    label = labels.where("pos >= 1").select(*by, (F.col("pos") - 1).cast(logits.schema["pos"].dataType).alias("pos"), F.lit(None).cast("long").alias("token_id"), F.lit(None).cast("double").alias("logit"), F.col("token_id").cast("long").alias("label"))
    rows = logits.select(*by, "pos", F.col("token_id").cast("long").alias("token_id"), F.col("logit").cast("double").alias("logit"), F.lit(None).cast("long").alias("label")).unionByName(label)
    own = rows.withColumn("_top", top).withColumn("_label", F.max("label").over(Window.partitionBy(*by, "pos")))
    part = F.sum(F.exp(F.col("logit") - F.col("_top")))
    got = own.where("_label is not null").groupBy(*by, "pos").agg(F.max(F.when(F.col("token_id") == F.col("_label"), F.col("logit") - F.col("_top"))).alias("_x"), F.log(part).alias("_log"), F.sum(F.exp(F.col("logit") - F.col("_top"))).alias("_sum"))
    return got.select(*by, (F.col("pos") + 1).alias("pos"), (F.col("_x") - F.col("_log")).alias("logp"), (F.col("_sum") / F.exp("_log")).alias("mass"))


class BackOff:
    """Interpolated back-off from pairs of tokens to tokens, by absolute discounts and continuation counts.

    A token after a known one has its discounted share of the pairs with that one, and what the discounts free goes to
    tokens by the number of different tokens that stand before them; there again the freed share is spread evenly over
    all known tokens and one unknown.  So the probabilities after any token sum to 1.
    """

    def __init__(self, pairs: DataFrame, discount: float = 0.75):
        """``pairs(prev, token)``: each neighbouring pair of the training text, repeats included."""
        if not 0 < discount < 1:
            raise ValueError("discount must be in (0, 1)")
        self.discount = discount
        self.pairs = stored(pairs.groupBy("prev", "token").agg(F.count("*").alias("n")), "pairs")
        self.before = self.pairs.groupBy("prev").agg(F.sum("n").alias("n_prev"), F.count("*").alias("kinds"))
        self.after = self.pairs.groupBy("token").agg(F.count("*").alias("n_before"))
        self.total = self.pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct("token").alias("n_tokens"))

    def score(self, rows: DataFrame, name: str = "logp") -> DataFrame:
        """``rows(prev, token)`` with the log-probability of ``token`` after ``prev``."""
        d = F.lit(self.discount)
        own = rows.join(lookup(self.pairs), ["prev", "token"], "left").join(lookup(self.before), "prev", "left").join(lookup(self.after), "token", "left").crossJoin(F.broadcast(self.total))  # one row
        none = lambda c: F.coalesce(c, F.lit(0))
        even = F.lit(1.0) / (F.col("n_tokens") + 1)
        low = F.when(F.col("n_pairs") > 0, (F.greatest(none("n_before") - d, F.lit(0.0)) + d * F.col("n_tokens") * even) / F.col("n_pairs")).otherwise(even)
        p = F.when(F.col("n_prev").isNull(), low).otherwise((F.greatest(none("n") - d, F.lit(0.0)) + d * F.col("kinds") * low) / F.col("n_prev"))
        return own.withColumn(name, F.log(p)).drop("n", "n_prev", "kinds", "n_before", "n_pairs", "n_tokens")


def uniform_score(vocabulary: int) -> Column:
    return F.lit(-1.0) * F.log(F.lit(float(vocabulary)))


def masked_sums(tokens: DataFrame, by: list[str], logp: list[str], weight: str = "w", normalised: bool = False) -> DataFrame:
    """Weighted log-probability sums of sequences; position 0 is never scored.

    Normalised sums are divided by the weights' sum, at least 1.
    """
    scored = F.col("pos") >= 1
    w = F.when(scored, F.col(weight)).otherwise(0.0)
    mass = F.greatest(F.lit(1.0), F.sum(w))
    return tokens.groupBy(*by).agg(*[((F.sum(w * F.col(c)) / mass) if normalised else F.sum(w * F.col(c))).alias(c) for c in logp])


def log_sigmoid(x: Column) -> Column:
    """Stable for either sign."""
    return -(F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def preference_rows(sums: DataFrame, by: list[str], beta: float = 0.1) -> DataFrame:
    """One row a pair from ``sums(by, side, policy, ref)``: rewards, margin and loss."""
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("policy") - F.col("ref")))
    got = sums.groupBy(*by).agg(of("chosen").alias("chosen_reward"), of("rejected").alias("rejected_reward"), F.coalesce(of("positive"), F.lit(0.0)).alias("positive_reward"))
    margin = F.col("chosen_reward") - F.col("rejected_reward")
    return got.withColumn("reward_margin", margin).withColumn("loss", -log_sigmoid(beta * margin))


def loss_metrics(rows: DataFrame, positive_weight: float = 0.0) -> DataFrame:
    """Batch means; the process-positive term counts rows without a prefix as 0 and is added to the loss."""
    positive = -F.avg("positive_reward") if positive_weight > 0 else F.lit(0.0)
    return rows.agg((F.avg("loss") + positive_weight * positive).alias("loss"), F.avg("chosen_reward").alias("chosen_reward"), F.avg("rejected_reward").alias("rejected_reward"), F.avg("reward_margin").alias("reward_margin"), positive.alias("process_positive_loss"))


def probe_deltas(means: DataFrame, probes: list[str]) -> DataFrame:
    """``means(variant, probe, before, after)`` as one wide row a variant with deltas."""
    cells = []
    for p in probes:
        pick = lambda c: F.coalesce(F.sum(F.when(F.col("probe") == p, F.col(c))), F.lit(0.0))  # noqa: E731,B023
        cells += [pick("before").alias(f"before_{p}"), pick("after").alias(f"after_{p}"), (pick("after") - pick("before")).alias(f"{p}_delta")]
    return means.groupBy("variant").agg(*cells)


def annotate_rejected(rows: DataFrame, sums: DataFrame, key: str, score: str = "policy") -> DataFrame:
    """Rows with ``weighted_rejected_logp`` from ``sums(key, side, score)``; null where none was scored."""
    own = sums.where("side = 'rejected'").select(key, F.col(score).alias("weighted_rejected_logp"))
    return rows.join(own, key, "left")
