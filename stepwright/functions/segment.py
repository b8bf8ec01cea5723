"""Responses cut into steps, and steps found again in their response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_ENDS, WS, clean, let, strip

# Step markers.
NUMBERED = r"(?iU)(?=(?:^|\n|\s)(?:step\s*\d+[:.)-]|\d+[:.)-]|\(\d+\)))"
CONNECTOR = r"(?iU)\b(Therefore|Thus|So|Hence|Then|Next)\b"
SENTENCE = rf"(?U)(?<=[.。;；]){WS}+"
MARK = "@@@"


def _texts() -> Column:
    return F.array().cast("array<string>")


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, clean), lambda x: x != "")


def _pack(step: Column, most: int) -> Column:
    """An overlong step as sentences packed greedily up to ``most`` characters."""

    def add(acc, piece):
        joined = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(" "), piece))
        full = F.length(joined) > most
        done = F.when(full & (acc["open"] != ""), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, piece).otherwise(joined).alias("open"))

    start = F.struct(_texts().alias("done"), F.lit("").alias("open"))
    close = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    packed = F.aggregate(F.filter(F.split(step, SENTENCE), lambda x: x != ""), start, add, close)
    return F.when(F.length(step) <= most, F.array(step)).otherwise(packed)


def _merge(steps: Column, least: int) -> Column:
    """Steps shorter than ``least`` take in the next one; a short last step joins the one before."""

    def add(acc, step):
        empty, short = acc["open"] == "", F.length(acc["open"]) < least
        done = F.when(empty | short, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        grown = F.when(empty, step).when(short, F.concat(acc["open"], F.lit(" "), step)).otherwise(step)
        return F.struct(done.alias("done"), grown.alias("open"))

    def close(acc):
        n = F.size(acc["done"])
        tail = F.concat(F.try_element_at(acc["done"], F.lit(-1)), F.lit(" "), acc["open"])
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(tail))
        return F.when(acc["open"] == "", acc["done"]).when((n > 0) & (F.length(acc["open"]) < least), joined).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(steps, F.struct(_texts().alias("done"), F.lit("").alias("open")), add, close)


def candidates(text: Column) -> Column:
    """Pieces by the first rule that gives two: lines, numbered steps, connector words; else sentences."""
    two = lambda pieces, rest: let(pieces, lambda p: F.when(F.size(p) >= 2, p).otherwise(rest))

    def of(t):
        marked = _pieces(F.split(F.regexp_replace(t, CONNECTOR, MARK + "$1"), MARK))
        return two(_pieces(F.split(t, LINE_ENDS)), two(_pieces(F.split(t, NUMBERED)), two(marked, _pieces(F.split(t, SENTENCE)))))

    return let(strip(text), of)


def segment_steps(text: Column, least: int = 8, most: int = 500) -> Column:
    """The steps of a response, null for null: cut, long ones split, short ones merged."""
    return _merge(F.flatten(F.transform(candidates(text), lambda s: _pack(s, most))), least)


def step_spans(text: Column, steps: Column) -> Column:
    """``array<struct<start,end>>`` of the steps in their text, searched from the end of the one before.

    A step that is not there as it is gets searched in the rest of the text with white space collapsed
    (its place then counts collapsed characters), and else stands right at the cursor.
    """
    span = "array<struct<start:int,end:int>>"

    def add(acc, step):
        at = acc["at"]
        place = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

        def searched(want):
            rest = F.regexp_replace(F.substring(text, at + 1, F.length(text)), rf"(?U){WS}+", " ")
            again = lambda i: F.when(i >= 0, place(at + i, at + i + F.length(want))).otherwise(place(at, F.least(F.length(text), at + F.length(want))))
            found = lambda i: F.when(i >= 0, place(i, i + F.length(want))).otherwise(let(F.call_function("locate", want, rest, F.lit(1)) - 1, again))
            return let(F.call_function("locate", want, text, at + 1) - 1, found)

        return let(let(strip(step), searched), lambda one: F.struct(F.concat(acc["out"], F.array(one)).alias("out"), F.greatest(at, one["end"]).cast("int").alias("at")))

    return F.aggregate(steps, F.struct(F.array().cast(span).alias("out"), F.lit(0).alias("at")), add, lambda acc: acc["out"])
