"""Sources, sinks, generators, providers, cascade, loss, splits and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from stepwright import streaming
from stepwright.functions import steps as S
from stepwright.operators import pairs as P
from stepwright.operators import quality as Q
from stepwright.operators import reports as R
from stepwright.operators import scores as L
from stepwright.plans import localisation as Z
from stepwright.sources import generators as G
from stepwright.sources import jsonl, providers
from stepwright.sources.prompts import judge_prompt, rollout_prompt


def test_jsonl_round_trip(spark, tmp_path):
    src = tmp_path / "in.jsonl"
    src.write_text('{"prompt": "p。", "chosen": "c", "rejected": "r"}\n\n  \n{"prompt": "q", "chosen": "c", "rejected": "r", "answer": null, "metadata": {"a": 1, "b": [true, 0.5, null]}}\n', encoding="utf-8")
    df = jsonl.read_jsonl(spark, str(src), jsonl.PAIR, ordinal="ord")
    assert [r.prompt for r in df.orderBy("ord").collect()] == ["p。", "q"]
    pairs = jsonl.as_pairs(df)
    assert [r.ord for r in df.orderBy("ord").collect()] == [0, 1]
    meta = [r.metadata.toPython() for r in pairs.orderBy("prompt").collect()]
    assert meta == [{}, {"a": 1, "b": [True, 0.5, None]}] and type(meta[1]["a"]) is int
    jsonl.write_jsonl(pairs.withColumn("v", F.lit("x")).coalesce(1), str(tmp_path / "out"), by="v")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("v=x/*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert {x["prompt"] for x in lines} == {"p。", "q"} and all("answer" in x for x in lines)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"prompt": \n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(bad), jsonl.PAIR).collect()
    with pytest.raises(Exception, match="rejected is missing"):
        jsonl.as_pairs(df.withColumn("rejected", F.lit(None).cast("string"))).collect()
    jsonl.write_report(spark.createDataFrame([("m", 0.5)], "model string, accuracy double"), str(tmp_path / "csv"))
    assert "m,0.5000" in "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))


@pytest.mark.parametrize("n, steps, errors", [(300, {4: 250, 5: 50}, {1: 250, 0: 50}), (1000, {4: 833, 5: 167}, {1: 834, 0: 166}), (2000, {4: 1666, 5: 334}, {1: 1667, 0: 333})])
def test_published_distributions(spark, n, steps, errors):
    d = Q.distributions(G.template_pairs(G.seeds_by_random(spark, n))).collect()
    of = lambda m: {r.value: r.n for r in d if r.measure == m}
    assert of("step_count") == {str(k): v for k, v in steps.items()} and of("first_error") == {str(k): v for k, v in errors.items()}
    assert of("chosen_correct") == {"true": n} and of("rejected_wrong") == {"true": n} and sum(of("template").values()) == n


def test_equation_check_finds_every_planted_error(spark):
    p = G.template_pairs(G.seeds_by_hash(spark, 3000))
    assert p.where(~S.arithmetic_error(F.col("prompt"), F.col("rejected_steps")).eqNullSafe(F.col("first_error_step"))).count() == 0
    back = P.shift_error(P.shift_error(p.where("size(rejected_steps) > first_error_step + 2"), 1), -1)
    assert back.select("idx", "first_error_step").exceptAll(p.select("idx", "first_error_step")).count() == 0


def test_pair_selection_and_repair(spark):
    c = spark.createDataFrame([("a", 2, "w1", False), ("a", 1, "w0", False), ("a", 3, "r", True), ("b", 1, "r", True), ("c", 1, "w", None)], "p string, o int, t string, ok boolean").withColumn("gold", F.lit("g"))
    got = {r.p: tuple(r)[1:] for r in P.select_pairs(c, ["p"], "t", "o", "ok", "gold").collect()}
    assert got == {"a": ("r", "w0", 3, True), "c": ("g", "w", 1, False)}


def test_variants_carry_metadata(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], 1, '{"gamma": 0.5, "k": "v", "n": 3, "deep": {"x": [1]}}')], "idx int, rejected_steps array<string>, first_error_step int, m string")
    rows = rows.withColumn("metadata", F.parse_json("m")).drop("m")
    of = lambda r: r.metadata.toPython()
    v = {r.weight_variant: of(r) for r in P.weight_variants(rows).collect()}
    assert set(v) == set(S.VARIANTS) and v["uniform_downweight"]["uniform_weight"] == 0.25 and v["vanilla"]["k"] == "v" and v["vanilla"]["deep"] == {"x": [1]}
    s = P.shift_error(rows, 1).first()
    assert s.step_weights == [0, 0, 1] and of(s)["reviewer_variant"] == "shift_error_+1" and of(s)["original_first_error_step"] == 1
    t = P.truncate_rejected(rows).first()
    assert (t.rejected_steps, t.rejected, t.first_error_step, t.step_weights, of(t)["original_num_rejected_steps"]) == (["a", "b"], "a\nb", 1, [1.0, 1.0], 3)
    assert P.positive_prefix(rows).first().positive_prefix == "a" and P.positive_prefix(rows, 2).count() == 0
    noisy = P.noise_error(rows, "idx", 1.0).first()
    assert noisy.first_error_step in (0, 2) and of(noisy)["localization_noisy"] is True


def test_split_is_exact_and_partition_invariant(spark):
    for n, ratio, want in ((1, 0.8, 1), (2, 0.9, 1), (10, 0.25, 2), (1000, 0.8, 800), (5, 0.01, 1)):
        df = spark.range(n)
        a = P.split_exact(df, ratio, "id")
        assert a.where("split = 'train'").count() == want and a.count() == n
        b = P.split_exact(df.repartition(5), ratio, "id")
        assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        P.split_exact(spark.range(0), 0.5, "id")
    with pytest.raises(ValueError):
        P.split_exact(spark.range(3), 1.0, "id")


def test_cascade_branches(spark):
    schema = "idx int, prompt string, rejected string, answer string, rejected_steps array<string>, prefix_success_rates array<double>, first_error_step int, localization_confidence double"
    rows = [
        (1, "p", "2 + 2 = 5\nso it is done", "#### 4", None, None, None, None),
        (2, "p", "x", "a", ["s1", "s2", "s3"], [0.9, 0.1, 0.0], 2, None),
        (3, "p", "x", "a", ["s1", "s2", "s3"], None, 2, None),
        (4, "p", "first step here\nsecond step #### 9", "#### 8", None, None, None, None),
        (5, "p", "first step here\nsecond step #### 9", None, None, None, None, None),
        (6, "p", "x", "a", ["s1", "s2"], [], None, None),
    ]
    got = {r.idx: r for r in Z.localise(spark.createDataFrame(rows, schema)).collect()}
    pick = lambda r: (r.branch, r.first_error_step, r.localization_confidence, r.step_weights)
    assert pick(got[1]) == ("arithmetic", 0, 1.0, [1.0, 0.5]) and got[1].prefix_success_rates == []
    assert pick(got[2]) == ("rates", 1, pytest.approx(0.8), [0, 1, 0.5])
    assert pick(got[3]) == ("label", 2, 1.0, [0, 0, 1])
    assert pick(got[4]) == ("heuristic", 1, 0.8, [0, 1])
    assert pick(got[5]) == ("heuristic", 0, 1.0, [1, 0.5])
    assert pick(got[6]) == ("rates", 0, 0.0, [])
    assert {r.idx for r in Z.localise(spark.createDataFrame(rows, schema), min_confidence=0.9).collect()} == {1, 3, 5}


def test_judge(spark):
    rows = [('{"first_error_step": 1, "confidence": 2, "rationale": "r"}', 1, 1.0, False), ('x {"first_error_step": "9"} y', 2, 0.0, False), ("none", 2, 0.0, True), ("{bad}", 2, 0.0, True), (None, 2, 0.0, True), ('{"first_error_step": -4, "confidence": "0.5"}', 0, 0.5, False)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "idx int, reply string").withColumn("rejected_steps", F.array(*map(F.lit, "abc"))).withColumn("rejected", F.lit("x"))
    got = sorted(Z.judged(df).collect(), key=lambda r: r.idx)
    assert [(r.first_error_step, r.localization_confidence, r.parse_failed) for r in got] == [tuple(r[1:]) for r in rows]
    assert "0. a\n1. b" in spark.range(1).select(judge_prompt(F.lit("p"), F.lit("g"), F.array(F.lit("a"), F.lit("b")))).first()[0]


def test_rollouts_with_a_provider(spark):
    rows = spark.createDataFrame([(1, "q", ["a", "b"], "#### 2")], "idx int, prompt string, steps array<string>, answer string")
    each = rows.select("*", F.posexplode("steps").alias("k", "s")).withColumn("prompt", rollout_prompt(F.col("prompt"), F.col("steps"), F.col("k")))
    out = providers.generate(providers.ask(each, 2), lambda ps: [("#### 2" if "\nb\n" in p else "#### 1", None) for p in ps])
    rates = R.success_rates(out.withColumn("ok", F.col("completion") == F.col("answer")), "idx", "k", "ok").first().rates
    assert rates == [0.0, 1.0] and providers.ask(each, 0).count() == 0


def test_loss_values(spark):
    toks = spark.createDataFrame([(1, s, p, w) for s in ("chosen", "rejected") for p, w in enumerate([0.0, 1.0, 1.0, 0.0])], "idx int, side string, pos int, w double").withColumn("policy", L.uniform_score(5)).withColumn("ref", L.uniform_score(5))
    s = L.masked_sums(toks, ["idx", "side"], ["policy", "ref"])
    assert s.first().policy == pytest.approx(-2 * math.log(5))
    assert L.masked_sums(toks, ["idx", "side"], ["policy"], normalised=True).first().policy == pytest.approx(-math.log(5))
    r = L.preference_rows(s, ["idx"])
    assert r.first().loss == pytest.approx(math.log(2))
    m = L.loss_metrics(r.withColumn("positive_reward", F.lit(0.5)), 0.2).first()
    assert m.process_positive_loss == pytest.approx(-0.5) and m.loss == pytest.approx(math.log(2) - 0.1)
    assert [round(x, 6) for x in spark.range(1).select(L.log_sigmoid(F.lit(800.0)), L.log_sigmoid(F.lit(-800.0))).first()] == [0, -800]


def test_bigram_scores_sum_to_one(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "token string, n long")
    pairs = spark.createDataFrame([("a", "a", 1), ("a", "b", 2)], "prev string, token string, n long")
    toks = spark.createDataFrame([("a", t) for t in ("a", "b", "?")], "prev string, token string")
    assert sum(math.exp(r.logp) for r in L.bigram_scores(toks, counts, pairs, 1.0).collect()) == pytest.approx(1.0)


def test_training_rows_with_positive_prefix(spark):
    p = P.positive_prefix(G.template_pairs(G.seeds_by_hash(spark, 6)).withColumn("step_weights", S.decayed(F.size("rejected_steps"), F.col("first_error_step"), 0.5)))
    t = Z.token_table(p, "idx")
    v = P.vocabulary_ids(t.groupBy("token").agg(F.min("idx").alias("first_row"), F.min("pos").alias("first_pos")))
    rows = Z.training_rows(p, "idx", v, 30).collect()
    assert {r.side for r in rows} == {"chosen", "rejected", "positive"} and all(len(r.input_ids) == len(r.response_mask) == len(r.attention_mask) <= 30 for r in rows)


def test_training_rows_are_whole_without_a_limit(spark):
    df = spark.createDataFrame([(1, "p " * 3, "c " * 1500, "a b\nc", ["a b", "c"], [0.5, 1.0])], "idx long, prompt string, chosen string, rejected string, rejected_steps array<string>, step_weights array<double>")
    ids = spark.createDataFrame([("p", 3), ("c", 4), ("a", 5)], "token string, token_id int")
    rows = {r.side: r for r in Z.training_rows(df, "idx", ids, most=None).collect()}
    assert rows["chosen"].input_ids == [3] * 3 + [4] * 1500 and rows["chosen"].response_mask == [0.0] * 3 + [1.0] * 1500
    assert rows["rejected"].input_ids == [3, 3, 3, 5, 2, 4] and rows["rejected"].response_mask == [0.0, 0.0, 0.0, 0.5, 0.5, 1.0]
    assert rows["chosen"].attention_mask == [1] * 1503


def test_training_batches_hold_every_token(spark, sf):
    from stepwright.plans import catalogue

    whole = {(r.idx, r.side): (r.n, r.mass) for r in catalogue._tokens(spark, sf).groupBy("idx", "side").agg(F.count("*").alias("n"), F.sum("w").alias("mass")).collect()}
    rows = catalogue.QUERIES["training_batches"](spark, sf).collect()
    assert len(rows) == len(whole) and max(n for n, _ in whole.values()) > 70
    assert {(r.idx, r.side): (r.n_real, pytest.approx(r.mass, abs=1e-6)) for r in rows} == whole


def test_streams_give_the_batch_results(spark, tmp_path):
    rows = G.template_pairs(G.seeds_by_hash(spark, 60)).withColumn("localization_confidence", (F.col("idx") % 10) / 10).select("prompt", "chosen", "rejected", "answer", "rejected_steps", "first_error_step", "localization_confidence")
    jsonl.write_jsonl(rows.repartition(3), str(tmp_path / "in"))
    how = {"least": 0.5, "sampled": False}

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = lambda: streaming.read_pairs(spark, str(tmp_path / "in"), files=1)
    got = collect(Z.localise(stream().drop("prefix_success_rates")), "localised", "append")
    assert got.count() == 60 and got.where("branch <> 'arithmetic'").count() == 0
    counts = {r.reason: r.n_rows for r in collect(streaming.running_rejects(stream(), **how), "rejects", "complete").collect()}
    want = {r.r: r.n for r in Q.reject_reason(rows, **how).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("r")).agg(F.count("*").alias("n")).collect()}
    assert counts == want
    acc = streaming.running_accuracy(streaming.with_steps(stream()).select(F.lit("m").alias("model"), (F.size("rejected_steps") > 4).alias("correct")))
    assert collect(acc, "acc", "complete").first().total == 60


def test_windowed_rates_close(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", (F.col("value") > 40).alias("ok"))
    e.write.parquet(str(tmp_path / "ev"))
    s = streaming.windowed_rates(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")), "ts", "event_type", "ok")
    q = s.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == e.count()


def test_strict_pairing_raises(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    for rows in ([(1, "p")], [(1, "p"), (2, "q"), (2, "r")], [(1, "p"), (2, "q"), (3, "r")]):
        with pytest.raises(Exception, match="sides differ"):
            P.pair_strictly(a, spark.createDataFrame(rows, "k int, b string"), ["k"]).collect()
    assert P.pair_strictly(a, spark.createDataFrame([(2, "q"), (1, "p")], "k int, b string"), ["k"]).count() == 2
    assert P.parse_named_paths(["a=b=c"]) == {"a": "b=c"}
    with pytest.raises(ValueError):
        P.parse_named_paths(["a"])
