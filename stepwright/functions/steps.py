"""First errors and step weights: arrays in, arrays out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_side, let, same_answer

VARIANTS = ("vanilla", "uniform_downweight", "prefix_masked", "first_error_only", "decayed")
PROBES = ("prefix", "error", "suffix", "mask")

# What the equation check reads.
PROBLEM = r"(?iU)has\s+(\d+)\s+packs\.\s+Each pack contains\s+(\d+)\s+pencils\.\s+Then\s+(\d+)\s+more"
EQUATION = r"(?U)(-?\d+)\s*([+*×x])\s*(-?\d+)\s*=\s*(-?\d+)"
_BIG = "decimal(38,0)"


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def decayed(n: Column, error: Column, gamma, clamp: bool = True) -> Column:
    """0 before the first error, 1 at it, then powers of ``gamma``; ``clamp`` moves the error into range."""
    if isinstance(gamma, (int, float)):
        if not 0 <= gamma <= 1:
            raise ValueError("gamma must be in [0, 1]")
        gamma = F.lit(float(gamma))
    m = F.greatest(F.lit(0), F.least(error, n - 1)) if clamp else error
    return F.transform(_indices(n), lambda k: F.when(k < m, 0.0).when(k == m, 1.0).otherwise(F.pow(gamma, k - m)))


def variant_weights(n: Column, error: Column, variant: Column, gamma: float = 0.5, uniform: float = 0.25) -> Column:
    """Step weights of a named variant, a column, so that one projection serves all of them."""

    def weight(k):
        return (
            F.when(variant == "vanilla", 1.0)
            .when(variant == "uniform_downweight", uniform)
            .when(k < error, 0.0)
            .when(k == error, 1.0)
            .when(variant == "prefix_masked", 1.0)
            .when(variant == "first_error_only", 0.0)
            .when(variant == "decayed", F.pow(F.lit(float(gamma)), k - error))
        )

    return F.when(variant.isin(*VARIANTS), F.transform(_indices(n), weight))


def probe_weights(n: Column, error: Column, probe: Column, gamma: float = 0.5) -> Column:
    """1 on the probe's steps, 0 elsewhere; ``mask`` has the decayed weights."""

    def weight(k):
        on = F.when(probe == "prefix", k < error).when(probe == "error", k == error).when(probe == "suffix", k > error)
        rest = F.when(k < error, 0.0).otherwise(F.pow(F.lit(float(gamma)), k - error))
        return F.when(probe == "mask", rest).otherwise(on.cast("double"))

    return F.when(probe.isin(*PROBES), F.transform(_indices(n), weight))


def localize(rates: Column, tau: float = 0.3, high: float = 0.8, low: float = 0.2) -> Column:
    """``struct<first_error, confidence, rates>`` of prefix success rates.

    The first drop by more than ``tau`` counts; without one, all low means the first step, all high the
    last with no confidence, else the first smallest rate.  No rates: (0, 0.0, []).
    """
    clamped = F.transform(rates, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return let(clamped, lambda q: _localize(q, tau, high, low))


def _localize(q: Column, tau: float, high: float, low: float) -> Column:
    n = F.size(q)
    at = lambda k: F.try_element_at(q, (k + 1).cast("int"))
    falls = F.filter(_indices(n), lambda k: (k > 0) & (at(k - 1) - at(k) > tau))

    def place(z):
        drop, lo, hi = z["drop"], z["lo"], z["hi"]
        first = F.when(n == 0, 0).when(drop.isNotNull(), drop).when(hi <= low, 0).when(lo >= high, n - 1).otherwise(F.array_position(q, lo) - 1)
        sure = F.when(n == 0, 0.0).when(drop.isNotNull(), F.least(F.lit(1.0), at(drop - 1) - at(drop))).when(hi <= low, 1.0 - hi).when(lo >= high, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - lo))
        return F.struct(first.cast("int").alias("first_error"), sure.alias("confidence"), q.alias("rates"))

    facts = F.struct(F.try_element_at(falls, F.lit(1)).alias("drop"), F.array_min(q).alias("lo"), F.array_max(q).alias("hi"))
    return let(facts, place)


def arithmetic_error(prompt: Column, steps: Column) -> Column:
    """0-based first step with a wrong equation, or with numbers other than the pencils problem's; else null."""
    ask = lambda i: F.regexp_extract(prompt, PROBLEM, i).try_cast(_BIG)
    problem = let(F.struct(ask(1).alias("n"), ask(2).alias("each"), ask(3).alias("more")), lambda z: F.struct((z["n"] * z["each"]).alias("product"), z["more"].alias("more")))

    def wrong(e, z):
        a, op, b, c = (F.element_at(e, i) for i in (1, 2, 3, 4))
        a, b, c = (x.try_cast(_BIG) for x in (a, b, c))
        plus = op == "+"
        false = F.when(plus, a + b != c).otherwise(a * b != c)
        other = F.when(plus, (a == z["product"]) & ((b != z["more"]) | (c != z["product"] + z["more"]))).otherwise(c != z["product"])
        return F.coalesce(false, F.lit(False)) | F.coalesce(other, F.lit(False))

    def parts(s):
        whole = F.regexp_extract_all(s, F.lit(EQUATION), F.lit(0))
        return F.transform(whole, lambda e: F.array(*[F.regexp_extract(e, EQUATION, i) for i in (1, 2, 3, 4)]))

    bad = lambda z: F.array_position(F.transform(steps, lambda s: F.exists(parts(s), lambda e: wrong(e, z))), True)
    return F.nullif(let(problem, bad), F.lit(0)).cast("int") - 1


def shifted(error: Column, n: Column, by: int) -> Column:
    return F.greatest(F.lit(0), F.least(error + by, n - 1))


def noisy(key: Column, error: Column, n: Column, rate: float, seed: int = 42) -> Column:
    """``struct<noisy, error>``: with probability ``rate`` another step, uniform, by hash of the key.

    The coin is reported even where a single step leaves nothing to choose.
    """
    u = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    coin = u("coin") < rate
    pick = F.floor(u("pick") * (n - 1)).cast("int")
    other = pick + F.when(pick >= error, 1).otherwise(0)
    return F.struct(coin.alias("noisy"), F.when(coin & (n > 1), other).otherwise(error).cast("int").alias("error"))


def heuristic_rates(steps: Column, answer: Column) -> Column:
    """Rates without rollouts: 1 where the prefix verifies, 0 at a wrong end, else 0.8; zeros without an answer."""
    n = F.size(steps)
    prefix = lambda k: F.array_join(F.slice(steps, F.lit(1), k + 1), "\n")
    rates = lambda g: F.transform(_indices(n), lambda k: F.when(let(prefix(k), lambda p: same_answer(p, g)), 1.0).when(k == n - 1, 0.0).otherwise(0.8))
    return F.when(answer.isNull(), F.transform(_indices(n), lambda k: F.lit(0.0))).otherwise(let(answer_side(answer), rates))
