"""White-space tokens with offsets, and weights brought from steps to tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, WS, let

#: Values of one block of a running sum.
BLOCK = 32


def words(text: Column) -> Column:
    """The tokens of ``scan`` without their places, which cost more than finding them."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def scan(text: Column) -> Column:
    """``array<struct<token,start,end>>`` of runs without white space, offsets in characters."""
    piece = F.regexp_extract_all(text, F.lit(rf"(?U){WS}*[^\s\x1c-\x1f]+"), F.lit(0))

    def placed(pieces):
        word = lambda p: F.ltrim(p, F.lit(SPACES))
        one = lambda p, end: F.struct(word(p).alias("token"), (end - F.length(word(p))).alias("start"), end.alias("end"))
        return F.zip_with(pieces, running_sums(F.transform(pieces, F.length)), one)

    return let(piece, placed)


def running_sums(values: Column) -> Column:
    """Sums of an integer array up to each place.

    Spark copies what an aggregate holds at every element, so sums are taken in blocks of ``BLOCK``, which start
    from the sums of the blocks before.
    """

    def sums(v, start):
        grown = F.aggregate(v, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(v))

    def cut(v):
        n = F.size(v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        ends = lambda bs: sums(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
        joined = let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.concat(F.array(F.lit(0)), ends(F.slice(bs, F.lit(1), F.size(bs) - 1))), sums)))
        return F.when(v.isNull(), F.lit(None).cast("array<int>")).when(n <= BLOCK, sums(v, F.lit(0))).otherwise(joined)

    return let(values, cut)


def token_weights(tokens: Column, spans: Column, weights: Column) -> Column:
    """Each token's weight: of the last step whose span it overlaps, 0 if none; spare steps are ignored."""
    pair = lambda s, w: F.when(s.isNotNull() & w.isNotNull(), F.struct(s["start"].alias("a"), s["end"].alias("e"), w.alias("w")))
    both = F.filter(F.zip_with(spans, weights, pair), lambda q: q.isNotNull())  # the longer one is padded with nulls

    def weigh(steps):
        hit = lambda t: F.filter(steps, lambda q: ~((t["end"] <= q["a"]) | (t["start"] >= q["e"])))
        return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(hit(t), F.lit(-1))["w"], F.lit(0.0)))

    return let(both, weigh)


def encode_pair(prompt_ids: Column, response_ids: Column, weights: Column | None, most: int, eos: int | None = None) -> Column:
    """``struct<input_ids, attention_mask, response_mask>``, cut on the right to ``most`` tokens.

    The prompt has weight 0; the response ``weights``, or 1 everywhere; an end token, weight 1, may
    follow.  Weights of another length than the response raise an error.
    """
    n = F.size(response_ids)
    own = F.array_repeat(F.lit(1.0), n) if weights is None else F.when(F.size(weights) == n, weights).otherwise(F.raise_error(F.lit("weights and response tokens differ in number")).cast("array<double>"))
    ids = F.concat(prompt_ids, response_ids)
    mask = F.concat(F.array_repeat(F.lit(0.0), F.size(prompt_ids)), own)
    if eos is not None:
        ids, mask = F.concat(ids, F.array(F.lit(eos).cast("bigint"))), F.concat(mask, F.array(F.lit(1.0)))
    ids, mask = F.slice(ids, F.lit(1), F.lit(most)), F.slice(mask, F.lit(1), F.lit(most))
    return F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), mask.alias("response_mask"))


def padded(values: Column, width: Column | int, fill) -> Column:
    """Right-padded to ``width``; only dense exports need it."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), width - F.size(values)).cast("int")))
