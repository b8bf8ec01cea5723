"""Rule bitmask ledger: each rule runs once, bits and measurements are kept, policies read the bits."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Base measurements of a text, in the ledger's order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper_words", "n_shout_words")
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def measure(data: bytes) -> tuple[int, ...]:
    """All measurements of one text (UTF-8 bytes), BASE then MORE."""
    words = data.split()
    n = len(words)
    space = sum(data.count(c) for c in _SPACES)
    points = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    symbols = sum(data.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    rep = 0
    if n > 3:
        seen: set[int] = set()
        twice: set[int] = set()  # hashes of repeated windows: a number for each instead of three words
        for w in zip(words, words[1:], words[2:]):
            h = hash(w)
            (twice if h in seen else seen).add(h)
        if twice:  # the same hash may be chance: count those windows by their words
            count = Counter(w for w in zip(words, words[1:], words[2:]) if hash(w) in twice)
            reach = -1
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if count.get(w, 0) > 1:
                    rep += i + 3 - max(i, reach)
                    reach = i + 3
    upper = shout = 0
    if b"!!" in data:
        shout = sum(1 for w in words if w.endswith(b"!!"))
    if not data.islower():
        upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    return n, points - space, symbols, dup, rep, len(lines), upper, shout


#: Where rules draw the line; a policy may draw some of them elsewhere.
LIMITS = {"words": 50, "repeated": 50, "symbols": 10, "lines": 4, "duplicates": 5, "shouts": 3, "uppers": 5, "shortest": 2, "longest": 14}
#: Rules in bit order: name and failure test on the measurements, columns or plain numbers, and limits.  Bits are never renumbered.
RULES = (
    ("few_words", lambda m, x: m["n_words"] < x["words"]),
    ("repeated_windows", lambda m, x: 100 * m["n_repeat_words"] > x["repeated"] * m["n_words"]),
    ("symbols", lambda m, x: x["symbols"] * m["n_symbols"] > m["n_words"]),
    ("duplicate_lines", lambda m, x: (m["n_lines"] >= x["lines"]) & (10 * m["n_dup_lines"] > x["duplicates"] * m["n_lines"])),
    ("shouting", lambda m, x: (10 * m["n_shout_words"] > x["shouts"] * m["n_words"]) | (10 * m["n_upper_words"] > x["uppers"] * m["n_words"])),
    ("short_mean_word", lambda m, x: m["word_chars"] < x["shortest"] * m["n_words"]),
    ("long_mean_word", lambda m, x: m["word_chars"] > x["longest"] * m["n_words"]),
)
RULE_NAMES = tuple(name for name, _ in RULES)


def rules(limits: dict = LIMITS) -> list[tuple[str, Column]]:
    m = {x: F.col(x) for x in (*BASE, *MORE)}
    return [(name, fails(m, limits)) for name, fails in RULES]


def _bits(limits: dict) -> Column:
    bits = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(rules(limits)):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


BASE_MASK = 0b11
#: Versioned policies: the rules in force as a mask.  A version is never changed, only superseded.
POLICIES = {"v1": BASE_MASK, "v2": 0b0000111, "v3": 0b1111111}
CURRENT = "v3"


def ledger(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, all measurements and ``fail_bits``: bit i is set where rule i fails.

    One pass over whole texts.  Null and empty texts measure zero everywhere and fail ``few_words``.
    A row out for each row in, repeated rows included; other columns of ``docs`` are ignored.
    """
    fields = [(x, "bigint") for x in (*BASE, *MORE)]
    m = C.map_texts(docs, keep, fields, lambda texts: [list(x) for x in zip(*map(measure, texts))] or [[] for _ in fields], text)
    return m.withColumn("fail_bits", _bits(LIMITS))


def redrawn(led: DataFrame, **limits: int) -> DataFrame:
    """A stored ledger with ``fail_bits`` for other limits, from its measurements; no text is read again."""
    if unknown := set(limits) - set(LIMITS):
        raise ValueError(f"no such limits: {sorted(unknown)}")
    return led.withColumn("fail_bits", _bits(LIMITS | limits))


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; texts are not read again."""
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0
    )


def ablations(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and kept if it were left out.

    One bitwise aggregation to a row for each distinct bit pattern (at most 2 to the rule count), then
    sums over those.  An empty ledger gives zeros.
    """
    mask = POLICIES[version] | BASE_MASK
    pats = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    aggs = []
    for i, name in enumerate(RULE_NAMES):
        if mask >> i & 1:
            b, own = F.col("bits"), F.lit(1 << i)
            total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
            aggs.append(F.struct(F.lit(name).alias("rule"), total(b.bitwiseAND(own) != 0).alias("failed"), total(b == own).alias("failed_alone"), total((b == 0) | (b == own)).alias("kept_without")).alias(f"r{i}"))
    one = pats.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


def fail_bits(data: bytes) -> int:
    """The ledger's ``fail_bits`` of one text."""
    m = dict(zip((*BASE, *MORE), measure(data)))
    return sum(1 << i for i, (_, fails) in enumerate(RULES) if fails(m, LIMITS))


def rejects(data: bytes, version: str = CURRENT) -> bool:
    """Whether a policy rejects one text by its bits."""
    return fail_bits(data) & (POLICIES[version] | BASE_MASK) != 0


def keep_documents(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents, all columns, that a policy keeps by the ledger's bits; one pass, no shuffle, no ledger stored."""
    return C.filter_texts(docs, lambda t: not rejects(t, version), text)


def stored(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The ledger, measurements and bits, as a table in the shared folder (it stays there), read back."""
    return C.written(ledger(docs, keep, text), "ledger")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(stored(C.table(spark, sf_dir, "documents")))
    return led.select("doc_id", *BASE, "base_failed", "kept", "fail_bits", *MORE)


#: Limits that the ablations also look at, by a name of their own.
REDRAWN = {"strict": {"words": 80, "duplicates": 3, "longest": 10}}


def query_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's ablations, and those of the current one with other limits, from one stored ledger; texts are read once."""
    led = stored(C.table(spark, sf_dir, "documents"))
    own = [(v, led, v) for v in POLICIES] + [(name, redrawn(led, **x), CURRENT) for name, x in REDRAWN.items()]
    each = [ablations(x, v).select(F.lit(name).alias("version"), "rule", "failed", "failed_alone", "kept_without") for name, x, v in own]
    return reduce(DataFrame.unionByName, each)


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
u AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS x FROM w),
v AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, x, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS hit FROM v),
m AS (SELECT r, x, hit OR coalesce(lag(hit) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS marked FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, count(*) FILTER (WHERE marked) AS rep, count(*) FILTER (WHERE ends_with(x, '!!')) AS shout,
    count(*) FILTER (WHERE octet_length(encode(x)) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')) AS upper_ FROM m GROUP BY r),
a AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(rep, 0) AS n_repeat_words, len(ls) AS n_lines, coalesce(upper_, 0) AS n_upper_words, coalesce(shout, 0) AS n_shout_words FROM w LEFT JOIN g USING (r)),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)::INT + 16 * (10 * n_shout_words > 3 * n_words OR 10 * n_upper_words > 5 * n_words)::INT
    + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 14 * n_words)::INT AS fail_bits FROM a)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

_ABLATED = ", ".join(f"('{v}', {mask | BASE_MASK}, '{name}', {1 << i})" for v, mask in [*POLICIES.items(), *((x, POLICIES[CURRENT]) for x in REDRAWN)] for i, name in enumerate(RULE_NAMES) if (mask | BASE_MASK) >> i & 1)
_STRICT = "(fail_bits & ~73) + (n_words < 80)::INT + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)::INT + 64 * (word_chars > 10 * n_words)::INT"
ORACLE_ABLATIONS = f"""WITH one AS ({ORACLE}), led AS (SELECT fail_bits, false AS strict FROM one UNION ALL SELECT {_STRICT}, true FROM one), p(version, mask, rule, own) AS (VALUES {_ABLATED})
SELECT version, rule, count(*) FILTER (WHERE fail_bits & own <> 0) AS failed, count(*) FILTER (WHERE fail_bits & mask = own) AS failed_alone,
  count(*) FILTER (WHERE fail_bits & mask & ~own = 0) AS kept_without FROM p JOIN led ON led.strict = (p.version = 'strict') GROUP BY version, rule"""
