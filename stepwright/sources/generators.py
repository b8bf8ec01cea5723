"""Arithmetic questions and preference pairs as integer functions of a seed.

A template is data: named numbers as SQL expressions over ``seed`` and earlier numbers, one of which a
rejected trace gets wrong, and texts with ``{name}`` in place of numbers.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions.text import let

from .prompts import STEP_BY_STEP, question

# Numbers, wording and the wrong number of each template.
TEMPLATES = (
    {
        "name": "inventory",
        "error": 1,
        "numbers": {"shelves": "3 + seed % 5", "boxes": "4 + seed % 7", "packs": "5 + seed % 6", "sold": "(seed % 4 + 1) * (3 + seed % 5)", "added": "10 + seed % 13", "all": "shelves * boxes", "first": "all * packs", "answer": "first - sold + added"},
        "wrong": {"first": "all * packs + boxes"},
        "question": "A store has {shelves} shelves with {boxes} boxes on each shelf. Each box contains {packs} markers. During the morning, {sold} markers are sold, and later {added} new markers are added. How many markers are in the store now?",
        "steps": (
            "There are {shelves} * {boxes} = {all} boxes.",
            "The boxes contain {all} * {packs} = {first} markers.",
            "After selling {sold} and adding {added}, the total is {first} - {sold} + {added} = {answer}.",
            "#### {answer}",
        ),
    },
    {
        "name": "tickets",
        "error": 1,
        "numbers": {"adults": "12 + seed % 11", "children": "8 + seed % 9", "adult_price": "9 + seed % 8", "child_price": "4 + seed % 5", "coupon": "15 + (seed % 6) * 5", "snacks": "18 + seed % 17", "adult_cost": "adults * adult_price", "child_cost": "children * child_price", "both": "adult_cost + child_cost", "answer": "both - coupon + snacks"},
        "wrong": {"child_cost": "children * child_price + children"},
        "question": "A group buys {adults} adult tickets at ${adult_price} each and {children} child tickets at ${child_price} each. They use a ${coupon} coupon, then spend ${snacks} on snacks. How many dollars do they spend in total?",
        "steps": (
            "The adult tickets cost {adults} * {adult_price} = {adult_cost} dollars.",
            "The child tickets cost {children} * {child_price} = {child_cost} dollars.",
            "Before the coupon and snacks, the subtotal is {adult_cost} + {child_cost} = {both} dollars.",
            "After the ${coupon} coupon and ${snacks} snacks, the total is {both} - {coupon} + {snacks} = {answer}.",
            "#### {answer}",
        ),
    },
    {
        "name": "garden",
        "error": 1,
        "numbers": {"rows": "5 + seed % 8", "per_row": "7 + seed % 9", "days": "3 + seed % 5", "daily": "4 + seed % 6", "lost": "6 + seed % 11", "first": "rows * per_row", "planted": "days * daily", "answer": "first + planted - lost"},
        "wrong": {"planted": "days * daily + days"},
        "question": "A garden starts with {rows} rows of flowers and {per_row} flowers in each row. For {days} days, {daily} more flowers are planted each day. Then {lost} flowers wilt. How many flowers are left?",
        "steps": (
            "The garden starts with {rows} * {per_row} = {first} flowers.",
            "The new planting adds {days} * {daily} = {planted} flowers.",
            "After {lost} flowers wilt, the total is {first} + {planted} - {lost} = {answer}.",
            "#### {answer}",
        ),
    },
    {
        "name": "classroom",
        "error": 1,
        "numbers": {"students": "18 + seed % 13", "pages": "6 + seed % 8", "packets": "3 + seed % 5", "packet_pages": "9 + seed % 7", "recycled": "20 + seed % 21", "own": "students * pages", "extra": "packets * packet_pages", "answer": "own + extra - recycled"},
        "wrong": {"extra": "packets * packet_pages + packet_pages"},
        "question": "A teacher prints {pages} pages for each of {students} students. She also prints {packets} extra packets with {packet_pages} pages each. If {recycled} pages are recycled, how many printed pages remain?",
        "steps": (
            "The student pages total {students} * {pages} = {own}.",
            "The extra packets total {packets} * {packet_pages} = {extra} pages.",
            "After recycling {recycled} pages, {own} + {extra} - {recycled} = {answer} pages remain.",
            "#### {answer}",
        ),
    },
    {
        "name": "recipe",
        "error": 0,
        "numbers": {"batches": "4 + seed % 7", "cups": "3 + seed % 5", "bought": "12 + seed % 9", "used": "5 + seed % 6", "flour": "batches * cups", "left": "bought - used", "answer": "flour + left"},
        "wrong": {"flour": "batches * cups + cups"},
        "question": "A bakery uses {cups} cups of flour for each batch of muffins and makes {batches} batches. It also buys {bought} more cups of flour, but uses {used} cups for bread. How many cups of flour are accounted for by muffins and remaining added flour?",
        "steps": (
            "The muffins use {batches} * {cups} = {flour} cups of flour.",
            "The remaining added flour is {bought} - {used} = {left} cups.",
            "Together that is {flour} + {left} = {answer} cups.",
            "#### {answer}",
        ),
    },
    {
        "name": "shipping",
        "error": 1,
        "numbers": {"crates": "6 + seed % 8", "items": "11 + seed % 10", "bad_crates": "1 + seed % 3", "bad_each": "2 + seed % 4", "bonus": "15 + seed % 12", "first": "crates * items", "damaged": "bad_crates * bad_each", "answer": "first - damaged + bonus"},
        "wrong": {"damaged": "bad_crates * bad_each + bad_crates"},
        "question": "A warehouse packs {crates} crates with {items} items in each crate. In {bad_crates} crates, {bad_each} items are damaged in each. Then {bonus} replacement items arrive. How many usable items are there?",
        "steps": (
            "The warehouse starts with {crates} * {items} = {first} items.",
            "The damaged items total {bad_crates} * {bad_each} = {damaged}.",
            "After replacements, there are {first} - {damaged} + {bonus} = {answer} usable items.",
            "#### {answer}",
        ),
    },
)


def number_sql(template: dict, wrong: bool = False) -> dict[str, str]:
    """Each number of a template as one SQL expression over ``seed``; ``wrong`` for a rejected trace."""
    out: dict[str, str] = {}
    for name, sql in (template["numbers"] | (template["wrong"] if wrong else {})).items():
        out[name] = "(" + re.sub(r"[a-z_]+", lambda m: out.get(m[0], m[0]), sql) + ")"
    return out


def text_sql(text: str, numbers: dict[str, str]) -> str:
    """A text with numbers filled in, as an SQL concatenation that Spark and others run."""
    parts = re.split(r"\{(\w+)\}", text)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "concat(" + ", ".join(f"CAST({numbers[p]} AS string)" if i % 2 else quoted(p) for i, p in enumerate(parts) if i % 2 or p) + ")"


def _by_template(make, kind: str) -> Column:
    """What ``make`` makes of a row's template.  In a lambda, as all templates in one generated method are more than the JVM compiles."""
    out = F.lit(None).cast(kind)
    for i, t in reversed(list(enumerate(TEMPLATES))):
        out = F.when(F.pmod(F.col("idx"), F.lit(len(TEMPLATES))) == i, make(t)).otherwise(out)
    return let(F.col("idx"), lambda _: out)


def seeds_by_random(spark: SparkSession, n: int, seed: int = 456, most: int = 1_000_000) -> DataFrame:
    """``idx, seed``: a Mersenne-Twister sequence drawn on the driver, for small sets that must repeat one."""
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.randint(0, most)) for i in range(n)], "idx long, seed long")


def seeds_by_hash(spark: SparkSession, n: int, seed: int = 456, most: int = 1_000_000) -> DataFrame:
    """``idx, seed`` without driver work: a hash of the index."""
    return spark.range(n).select(F.col("id").alias("idx"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(most + 1)).alias("seed"))


def drawn_seeds(rows: DataFrame, key: str, seed: int = 456, most: int = 1_000_000) -> DataFrame:
    """``rows`` with a ``seed`` from 0 to ``most`` by hash of the key: the same in every run and for any partitioning."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    return rows.withColumn("seed", drawn % (most + 1))


def template_eval(seeds: DataFrame) -> DataFrame:
    """``prompt, answer, template`` and ``idx`` of evaluation questions; template by ``idx`` round robin."""
    q = _by_template(lambda t: F.expr(text_sql(t["question"], number_sql(t))), "string")
    answer = _by_template(lambda t: F.expr(text_sql("#### {answer}", number_sql(t))), "string")
    return seeds.select("idx", question(q, STEP_BY_STEP).alias("prompt"), answer.alias("answer"), _by_template(lambda t: F.lit(t["name"]), "string").alias("template"))


def template_pairs(seeds: DataFrame) -> DataFrame:
    """Pairs with known first errors: the chosen trace is right, the rejected one carries one wrong number on."""
    steps = lambda wrong: _by_template(lambda t: F.array(*[F.expr(text_sql(s, number_sql(t, wrong))) for s in t["steps"]]), "array<string>")
    q = _by_template(lambda t: F.expr(text_sql(t["question"], number_sql(t))), "string")
    out = seeds.select("idx", question(q, STEP_BY_STEP).alias("prompt"), steps(False).alias("chosen_steps"), steps(True).alias("rejected_steps"), _by_template(lambda t: F.lit(t["error"]), "int").alias("first_error_step"), _by_template(lambda t: F.lit(t["name"]), "string").alias("template"))
    return out.select("idx", "prompt", F.array_join("chosen_steps", "\n").alias("chosen"), F.array_join("rejected_steps", "\n").alias("rejected"), F.try_element_at("chosen_steps", F.lit(-1)).alias("answer"), "chosen_steps", "rejected_steps", "first_error_step", "template", F.lit(1.0).alias("localization_confidence"))


def toy_questions(rows: DataFrame) -> DataFrame:
    """``idx, question, answer`` of the pencils problem from ``idx``."""
    a, b, c = F.col("idx") + 12, F.col("idx") % 7 + 3, F.col("idx") % 5 + 2
    q = F.format_string("A box has %d packs. Each pack contains %d pencils. Then %d more pencils are added. How many pencils are there in total?", a, b, c)
    return rows.select("idx", q.alias("question"), F.format_string("#### %d", a * b + c).alias("answer"))


def placeholder_pairs(questions: DataFrame) -> DataFrame:
    """Pairs whose chosen and rejected texts are the gold answer, to be replaced by sampled ones."""
    from .prompts import PLACEHOLDER

    a = F.col("answer")
    return questions.select("idx", question(F.col("question"), PLACEHOLDER).alias("prompt"), a.alias("chosen"), a.alias("rejected"), a.alias("answer"))


def head(questions: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """The first ``n`` rows by position."""
    return questions.orderBy(order).limit(n)
