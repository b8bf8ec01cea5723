"""Text columns with Python-like white space, and answers as extracted, normalised and compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it: the Unicode property plus the four separators U+001C to U+001F.
WS = r"[\s\x1c-\x1f]"
#: The same as characters, for trims, which take no pattern.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

# What counts as an answer.
BOXED = r"\\boxed\{([^{}]+)\}"
MARKED = r"(?iU)(?:####|answer\s*(?:is|=|:)|therefore\s*,?\s*the\s*answer\s*is)\s*([^\n]+)"
#: What a text without ``WORD`` can have of MARKED, a quicker search.
HASHED, WORD = r"####(?U:\s*)([^\n]+)", r"(?iU)answer"
NUMBER = r"(?U)[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:/\d+(?:,\d{3})*)?"
UNWRAP = r"\\(?:text|mathrm)\{([^{}]+)\}"

#: Numbers that are their own normal form.
_PLAIN = r"^[-+]?\d+(\.\d+)?\z"
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_RATIO = r"^[-+]?\d+/\d+$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """The text, null where it is empty; ``nullif`` inside a lambda would compute it twice."""
    return let(c, lambda x: F.when(x != "", x))


def clean(c: Column) -> Column:
    """White space collapsed to single spaces and stripped."""
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def last_match(c: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def extract_answer(c: Column) -> Column:
    """The last boxed text, else what the last answer marker announces, else the last number, else null."""
    def of(t):
        marked = F.when(t.rlike(WORD), last_match(t, MARKED, 1)).otherwise(last_match(t, HASHED, 1))
        said = let(marked, lambda x: F.coalesce(last_match(x, NUMBER, 0), strip(x)))
        return F.when(t == "", F.lit(None)).otherwise(F.coalesce(strip(last_match(t, BOXED, 1)), said, last_match(t, NUMBER, 0)))

    return let(strip(c), of)


def normalize_answer(c: Column) -> Column:
    """Without commas, dollar signs, text wrappers and trailing full stops; null when nothing is left."""
    def of(t):
        bare = strip(F.regexp_replace(F.translate(t, ",$", ""), UNWRAP, "$1"))
        return F.when(t.rlike(_PLAIN), t).otherwise(filled(F.regexp_replace(bare, r"\.+$", "")))

    return let(c, of)


def float_value(t: Column) -> Column:
    """Stripped text as a double: decimal, ``inf`` or ``nan``; null for others."""
    plain = F.when(t.rlike(_FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    word = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    minus = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    named = F.when(word.isin("inf", "infinity"), minus * F.lit(float("inf"))).when(word == "nan", F.lit(float("nan")))
    return F.coalesce(plain, named)


def answer_value(c: Column) -> Column:
    """A normalised answer as a double: ratio, decimal, ``inf`` or ``nan``; null for others and for x/0."""
    def of(t):
        part = lambda i: F.split_part(t, F.lit("/"), F.lit(i)).try_cast("double")
        return F.coalesce(F.when(t.rlike(_RATIO), F.try_divide(part(1), part(2))), float_value(t))

    return let(c, lambda t: F.when(t.rlike(_PLAIN), t.try_cast("double")).otherwise(let(strip(normalize_answer(t)), of)))


def final_answer(c: Column) -> Column:
    return normalize_answer(F.coalesce(filled(extract_answer(c)), c))


def answer_side(c: Column) -> Column:
    """``struct<t, v>``: an answer's text and value, for comparing one answer with many."""
    return let(final_answer(c), lambda t: F.struct(t.alias("t"), answer_value(t).alias("v")))


def same_answer(prediction: Column, g: Column, atol: float = 1e-4) -> Column:
    """Whether a prediction's answer is that of side ``g``; its value is computed only if the texts differ."""
    y = g["v"]
    near = lambda x: x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & ((x == y) | (F.abs(x - y) <= atol))
    return let(final_answer(prediction), lambda t: F.coalesce((t == g["t"]) | let(answer_value(t), near), F.lit(False)))


def verify_answer(prediction: Column, gold: Column, atol: float = 1e-4) -> Column:
    """Whether both answers are equal as text, or as numbers within ``atol``; false where one is missing."""
    return let(answer_side(gold), lambda g: same_answer(prediction, g, atol))
