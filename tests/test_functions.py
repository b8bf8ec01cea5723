"""Functions against literal cases and a plain Python restatement."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from stepwright.functions import registry
from stepwright.functions import steps as S
from stepwright.functions import tokens as K
from stepwright.functions.segment import segment_steps, step_spans
from stepwright.functions.text import answer_value, extract_answer, normalize_answer, verify_answer

#: Texts, their steps, where the steps stand, and their steps of 20 to 60 characters.
_SAME = "A sentence of some length stands here."
_CASES = [
    ("", [], [], []),
    ("  \n ", [], [], []),
    ("1. Let x = 2.\n2. Then x + 3 = 5.\n3. Therefore the answer is 5.", ["1. Let x = 2.", "2. Then x + 3 = 5.", "3. Therefore the answer is 5."], [(0, 13), (14, 32), (33, 62)], ["1. Let x = 2. 2. Then x + 3 = 5.", "3. Therefore the answer is 5."]),
    ("1. Let x = 2. 2. Then (3) ok", ["1. Let x =", "2. 2. Then (3) ok"], [(0, 10), (11, 28)], ["1. Let x = 2. 2. Then (3) ok"]),
    (" 3.50 is what it costs. Ok.", ["3.50 is what it costs. Ok."], [(1, 27)], ["3.50 is what it costs. Ok."]),
    ("Step 1: add. Step 2: mul.", ["Step 1: add.", "Step 2: mul."], [(0, 12), (13, 25)], ["Step 1: add. Step 2: mul."]),
    ("a\u00a0b  c\x0bd\x1ce\u2028f", ["a b c d e f"], [(0, 11)], ["a b c d e f"]),
    ("we keep @@@ this @@@ apart from that", ["we keep this", "apart from that"], [(0, 12), (21, 36)], ["we keep this apart from that"]),
    ("éThen we go on So it is", ["éThen we go on", "So it is"], [(0, 14), (15, 23)], ["éThen we go on So it is"]),
    ("First one here。second one；third ; and the fourth", ["First one here。second one；third ;", "and the fourth"], [(0, 33), (34, 48)], ["First one here。second one；third ; and the fourth"]),
    ("x" * 600, ["x" * 600], [(0, 600)], ["x" * 600]),
    ("word " * 300, [("word " * 300).strip()], [(0, 1499)], [("word " * 300).strip()]),
    (" ".join([_SAME] * 30), [_SAME] * 30, [(39 * i, 39 * i + 38) for i in range(30)], [_SAME] * 30),
    ("ab\ncd\nefghijklmnop\nq", ["ab cd efghijklmnop q"], [(0, 20)], ["ab cd efghijklmnop q"]),
    ("So", ["So"], [(0, 2)], ["So"]),
    ("so it goes, then hence it went. Next", ["so it goes,", "then hence it went. Next"], [(0, 11), (12, 36)], ["so it goes, then hence it went. Next"]),
    ("one line only without marks", ["one line only without marks"], [(0, 27)], ["one line only without marks"]),
    ("\r\nfirst line\r\n\r\nsecond line\r", ["first line", "second line"], [(2, 12), (16, 27)], ["first line second line"]),
]
TEXTS = [c[0] for c in _CASES] + ["tiny\n" + "long sentence number one is here; " * 25]


def run(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def letters(t):
    return re.sub(r"\s+", "", t)


def test_segmentation_and_spans_of_literal_texts(spark):
    cols = ("t", segment_steps(F.col("t")), step_spans(F.col("t"), segment_steps(F.col("t"))), segment_steps(F.col("t"), 20, 60))
    got = {t: (s, [tuple(x) for x in p], few) for t, s, p, few in run(spark, [(c[0],) for c in _CASES], "t string", *cols)}
    assert got == {c[0]: c[1:] for c in _CASES}
    assert run(spark, [(None,)], "t string", segment_steps(F.col("t"))) == [(None,)]


def test_segmentation_and_spans_keep_what_they_must(spark, sf):
    """Nothing but white space is lost, steps keep their bounds and stand where they are said to."""
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()] + [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", segment_steps(F.col("t")))
    for r in df.withColumn("p", step_spans(F.col("t"), F.col("s"))).collect():
        steps, spans = r.s, [tuple(x) for x in r.p]
        if "@@@" not in r.t:
            assert letters("".join(steps)) == letters(r.t)
        assert all(x and x == x.strip() for x in steps) and (len(steps) < 2 or min(map(len, steps)) >= 8)
        assert len(spans) == len(steps) and all(0 <= a <= b <= len(r.t) for a, b in spans)
        assert all(later[0] >= one[0] for one, later in zip(spans, spans[1:]))
        for x, (a, b) in zip(steps, spans):
            assert r.t[a:b] == x or x not in r.t[a:]


def test_answers(spark):
    cases = {
        "We compute it. #### 42": "42",
        "So the answer is \\boxed{7/2}.": "7/2",
        "Final answer. #### 362Human: next prompt": "362",
        "": None,
        " \n": None,
        "no digits": None,
        "#### about ten": "about ten",
        "1, 2 and 3,456.50 then": "3,456.50",
        "answer = 5\nThe ANSWER IS 7 or 8\nand 9": "8",
        "\\boxed{ } \\boxed{ x } ": "x",
        "therefore , the answer is -3/4": "-3/4",
    }
    got = dict(run(spark, [(t,) for t in cases], "t string", "t", extract_answer(F.col("t"))))
    assert got == cases
    norm = {"$1,024.": "1024", "\\text{ab c}": "ab c", "...": None, " \\mathrm{x}.. ": "x", "a b": "a b"}
    assert dict(run(spark, [(t,) for t in norm], "t string", "t", normalize_answer(F.col("t")))) == norm


def python_value(t):
    if re.fullmatch(r"[-+]?\d+/\d+", t):
        a, b = t.split("/")
        return int(a) / int(b) if int(b) else None
    try:
        return float(t)
    except ValueError:
        return None


def test_answer_values_and_verdicts(spark):
    words = ["3", "3.5", "7/2", "-1/4", "7/0", "1d", "1_000", "1__0", "inf", "-Infinity", "nan", "1e5", ".5", "5.", "x", "1f", "+2"]
    for t, v in run(spark, [(w,) for w in words], "t string", "t", answer_value(F.col("t"))):
        want = python_value(t.rstrip("."))
        assert v == want or (math.isnan(v) and math.isnan(want)), t
    rows = [
        ("The answer is 3.5", "\\boxed{7/2}", True),
        ("#### 1,024", "1024", True),
        ("Final answer. #### 362Human: next prompt", "#### 362", True),
        ("#### 5", "6", False),
        ("", "1", False),
        ("inf", "inf", True),
        ("#### 1.00005", "1", True),
        ("#### 1.0002", "1", False),
        ("yes", "yes", True),
        (None, "1", False),
    ]
    assert run(spark, rows, "p string, g string, w boolean", verify_answer(F.col("p"), F.col("g")), "w") == [(w, w) for *_, w in rows]


def test_quicker_paths_find_the_same_answers(spark):
    """Texts without the word ``answer`` and plain numbers take shorter ways."""
    said = {"#### 5\n#### \t\n": "5", "####\n\u2003 7 or 8": "8", "####x #### y": "x #### y", "an\u017fwer: 3 of 4": "4", "ANSWER=#### b": "#### b", "therefore 9": "9"}
    assert dict(run(spark, [(t,) for t in said], "t string", "t", extract_answer(F.col("t")))) == said
    rows = [("#### 5. .", "5", True), ("-5", "-5.0", True), ("+5", "5", True), ("5", "5.0002", False), (" 5\n", "#### 5", True), ("9" * 400, "9" * 400, True), ("1", None, False), (None, None, False)]
    assert run(spark, rows, "p string, g string, w boolean", verify_answer(F.col("p"), F.col("g")), "w") == [(w, w) for *_, w in rows]


def test_localisation_from_rates(spark):
    cases = [
        ([], 0, 0.0),
        ([0.75, 0.75, 0.0, 0.0], 2, 0.75),
        ([1.0, 0.6, 0.1], 1, 0.4),  # the first of two drops, not the larger
        ([0.9, 0.65, 0.4], 2, 0.6),  # no drop is large enough: the smallest rate
        ([0.5, 0.25, 0.25, 0.5], 1, 0.75),  # the first of two smallest
        ([0.1, 0.2, 0.0], 0, 0.8),  # all low
        ([0.8, 1.0, 0.9], 2, 0.0),  # all high
        ([1.5, 0.5], 1, 0.5),  # rates are clamped before they are compared
        ([-1.0, 0.5], 0, 1.0),
        ([0.25], 0, 0.75),
        ([0.2], 0, 0.8),
        ([0.8], 0, 0.0),
    ]
    for (i, z), (_, at, sure) in zip(run(spark, [(c[0], k) for k, c in enumerate(cases)], "q array<double>, k int", "k", S.localize(F.col("q"))), cases):
        assert (z.first_error, z.confidence) == (at, pytest.approx(sure)), cases[i]


def test_a_planted_drop_is_found(spark):
    rows = [([0.9 - 0.05 * k for k in range(at)] + [0.3 - 0.05 * (at - 1)] + list(rest), at) for at in range(1, 6) for rest in itertools.product([0.0, 0.5, 1.0], repeat=2)]
    for at, z in run(spark, rows, "q array<double>, k int", "k", S.localize(F.col("q"))):
        assert z.first_error == at and z.confidence == pytest.approx(0.6)


def test_weights(spark):
    rows = [(5, 2), (4, 9), (3, -1), (0, 0), (1, 0)]
    got = run(spark, rows, "n int, m int", S.decayed(F.col("n"), F.col("m"), 0.5), S.decayed(F.col("n"), F.col("m"), 0.5, clamp=False))
    assert got[0][0] == [0, 0, 1, 0.5, 0.25] and got[1] == ([0, 0, 0, 1], [0, 0, 0, 0]) and got[2] == ([1, 0.5, 0.25], [0.5, 0.25, 0.125])
    assert got[3] == ([], []) and got[4][0] == [1]
    with pytest.raises(ValueError):
        S.decayed(F.lit(1), F.lit(0), 1.5)
    probes = {p: run(spark, [(5, 1)], "n int, m int", S.probe_weights(F.col("n"), F.col("m"), F.lit(p), 0.5))[0][0] for p in S.PROBES}
    assert [sum(x) for x in zip(probes["prefix"], probes["error"], probes["suffix"])] == [1] * 5
    of = lambda v, g: run(spark, [(5, 1)], "n int, m int", S.variant_weights(F.col("n"), F.col("m"), F.lit(v), g))[0][0]
    assert of("decayed", 0.0) == of("first_error_only", 0.5) and of("decayed", 1.0) == of("prefix_masked", 0.5)
    assert of("decayed", 0.25) == [0, 1, 0.25, 0.0625, 0.015625]


def test_equation_check(spark):
    p = "It has {} packs. Each pack contains {} pencils. Then {} more"
    rows = [
        (p.format(12, 3, 2), ["12 × 3 = 36", "36 + 2 = 39", "#### 39"], 1),
        (p.format(13, 4, 3), ["13 × 4 = 52", "52 + 4 = 56", "#### 56"], 1),
        (p.format(13, 4, 3), ["13 x 4 = 52", "52 + 3 = 55", "#### 55"], None),
        (p.format(13, 4, 3), ["2 * 3 = 6"], 0),
        ("none", ["2 * 3 = 6", "1 + 1 = 2 and 2 + 2 = 5"], 1),
        ("none", ["7 - 2 = 4"], None),
        ("none", [], None),
        ("none", ["99999999999999999999 + 1 = 100000000000000000000"], None),
    ]
    assert run(spark, rows, "p string, s array<string>, w int", S.arithmetic_error(F.col("p"), F.col("s")), "w") == [(w, w) for *_, w in rows]


def test_noise_is_uniform_and_skips_the_label(spark):
    df = spark.range(20_000).select(S.noisy(F.col("id"), F.lit(1), F.lit(4), 0.25).alias("z")).groupBy("z.noisy", "z.error").count().collect()
    n = {(r.noisy, r.error): r["count"] for r in df}
    assert set(n) == {(False, 1), (True, 0), (True, 2), (True, 3)}
    assert abs(n[False, 1] / 20_000 - 0.75) < 0.02 and all(abs(n[True, k] / 20_000 - 0.25 / 3) < 0.01 for k in (0, 2, 3))
    assert spark.range(50).select(S.noisy(F.col("id"), F.lit(0), F.lit(1), 1.0).alias("z")).where("z.error <> 0 or not z.noisy").count() == 0


def test_tokens_and_encoding(spark):
    rows = run(spark, [(t,) for t in TEXTS], "t string", "t", K.scan(F.col("t")))
    for t, toks in rows:
        assert [tuple(x) for x in toks] == [(m[0], *m.span()) for m in re.finditer(r"\S+", t)]
    w = K.token_weights(K.scan(F.lit("ab cd ef")), F.expr("array(struct(0 as start, 4 as end), struct(3 as start, 5 as end))"), F.array(F.lit(1.0), F.lit(0.5), F.lit(9.0)))
    assert spark.range(1).select(w).first()[0] == [1.0, 0.5, 0.0]
    enc = K.encode_pair(F.expr("array(5L, 6L)"), F.expr("array(7L, 8L, 9L)"), F.expr("array(0.0D, 1.0D, 0.5D)"), 4)
    assert tuple(spark.range(1).select(enc.alias("e")).first().e) == ([5, 6, 7, 8], [1, 1, 1, 1], [0.0, 0.0, 0.0, 1.0])
    assert spark.range(1).select(K.padded(F.expr("array(1, 2)"), 4, 0)).first()[0] == [1, 2, 0, 0]
    with pytest.raises(Exception, match="differ in number"):
        spark.range(1).select(K.encode_pair(F.expr("array(5L)"), F.expr("array(7L)"), F.expr("array(0.0D, 1.0D)"), 4)).collect()


def test_registered_functions(spark):
    registry.register(spark)
    r = spark.sql("select step_weights(5, 2, 0.5D) a, step_weights(0, 0, 0.5D) b, shift_step(3, 4, 1) c, clean_text(' a \u00a0 b ') d, log_sigmoid(0.0D) e, looks_truncated('x = ') f, split_hash(42, '7') g").first()
    assert (r.a, r.b, r.c, r.d, r.f) == ([0, 0, 1, 0.5, 0.25], [], 3, "a b", True) and r.e == pytest.approx(-math.log(2)) and len(r.g) == 32
