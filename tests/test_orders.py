"""Numbers, batches, range joins, logits, back-off, increments, caches and keyed streams at their edges."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stepwright import streaming
from stepwright.functions import steps as S
from stepwright.functions import tokens as K
from stepwright.operators import intervals as I
from stepwright.operators import order as O
from stepwright.operators import scores as L
from stepwright.sources import jsonl as J
from stepwright.sources import providers as V


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"prompt": f"p{i}", "chosen": "c" * (i % 60), "rejected": "r"} for i in range(500)]
    cuts = [0, 3, 3, 200, 480, 500]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (src / f"part-{k}.json").write_text("".join(json.dumps(r) + ("\n\n" if i % 7 == 0 else "\n") for i, r in enumerate(rows[a:b])))
    for size in ("128m", "4096", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r.prompt: r.at for r in J.read_jsonl(spark, str(src), J.PAIR, ordinal="at").select("prompt", "at").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {f"p{i}": i for i in range(500)}


def test_metadata_keep_their_types(spark):
    values = ['{"a":1,"b":"x"}', None, '{"b":null,"c":[1,{"d":true}]}', "{}", "null", "[1]"]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for r in df.select("i", F.to_json(J.merge_metadata(F.parse_json("a"), F.parse_json("b"))).alias("m")).collect():
        a, b = (json.loads(x or "null") for x in rows[r.i][1:])
        assert json.loads(r.m) == {**(a if isinstance(a, dict) else {}), **(b if isinstance(b, dict) else {})}


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    keys = rng.sample(range(10**6), 400)
    df = spark.createDataFrame([(k // 1000, k, "x") for k in keys], "a int, b int, _c0 string")
    for parts in (1, 7):
        got = {r.b: r.n for r in O.numbered(df.repartition(parts), ["a", "b"], "n", 5).collect()}
        assert got == {k: i + 5 for i, k in enumerate(sorted(keys))}
    assert O.numbered(df.limit(0), ["b"]).count() == 0


def test_batches_of_like_lengths(spark):
    df = spark.createDataFrame([(i, [1] * (i * 7 % 13)) for i in range(50)] + [(60, [])], "k int, ids array<int>")
    rows = O.padded_batches(df, "ids", "k", 8).collect()
    order = sorted((i * 7 % 13 if i < 60 else 0, i) for i in (*range(50), 60))
    assert {r.k: (r.batch, r.place) for r in rows} == {i: divmod(n, 8) for n, (_, i) in enumerate(order)}
    for r in rows:
        assert len(r.ids) == len(r.attention_mask) == r.width == max(n for k, (n, i) in enumerate(order) if k // 8 == r.batch)
    with pytest.raises(ValueError):
        O.length_batches(df, F.size("ids"), "k", 0)


def test_cycles(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    got = sorted((r.step, r.place, r.k) for r in O.cyclic_batches(df, ["k"], 9, 2).collect())
    assert got == [(s, p, (2 * s + p) % 5) for s in range(9) for p in range(2)]
    assert sorted(r.k for r in O.cyclic_batches(df, ["k"], 1, 12).collect()) == sorted(i % 5 for i in range(12))
    assert O.cyclic_batches(df.limit(0), ["k"], 3, 2).count() == 0


def test_range_join_gives_the_row_form(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 30)))
        spans = []
        for k in range(rng.randint(0, 6)):
            a = rng.randint(0, len(text))
            spans.append((a, min(len(text), a + rng.choice([0, 1, 5, 40, 400])), rng.choice([0.0, 0.25, 1.0])))
        rows.append((i, text, [s[:2] for s in spans], [s[2] for s in spans]))
    df = spark.createDataFrame(rows, "i int, text string, s array<struct<start:int,end:int>>, w array<double>")
    row = df.select("i", F.posexplode(K.token_weights(K.scan(F.col("text")), F.col("s"), F.col("w"))).alias("pos", "w"))
    toks = df.select("i", F.posexplode(K.scan(F.col("text"))).alias("pos", "t")).select("i", "pos", "t.*")
    spans = df.select("i", "w", F.posexplode("s").alias("k", "s")).select("i", "k", "s.start", "s.end", F.try_element_at("w", F.col("k") + 1).alias("w"))
    for width in (1, 7, 1024):
        assert I.weights_by_span(toks, spans, ["i"], width).select("i", "pos", "w").exceptAll(row).count() == 0
    assert toks.count() == row.count()


def test_a_very_long_text_is_spread_over_tasks(spark):
    n = 1_000_000
    toks = spark.range(n).select(F.lit(1).alias("i"), F.col("id").alias("pos"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 4).cast("int").alias("end"))
    spans = spark.createDataFrame([(1, 0, 0, 5 * n, 0.5), (1, 1, 2_000_000, 2_000_100, 1.0)], "i int, k int, start int, end int, w double")
    got = I.weights_by_span(toks, spans, ["i"], 65_536)
    assert [r[0] for r in got.groupBy().agg(F.sum("w")).collect()] == [pytest.approx(0.5 * (n - 20) + 20)]
    keys = {r[0] for r in spark.range(5 * n // 65_536).select(F.pmod(F.hash(F.lit(1), "id"), F.lit(4))).distinct().collect()}
    assert len(keys) == 4  # (row, bucket) reaches every task


def test_log_softmax(spark):
    rng = random.Random(6)
    logits = [(i, p, t, rng.uniform(-5, 5) * (200 if i == 1 else 1)) for i in range(3) for p in range(4) for t in range(9)]
    df = spark.createDataFrame(logits, "i int, pos int, token_id long, logit double")

    def want(i, p):
        own = {t: x for a, b, t, x in logits if (a, b) == (i, p)}
        top = max(own.values())
        z = top + math.log(sum(math.exp(x - top) for x in own.values()))
        return {t: x - z for t, x in own.items()}

    for r in L.log_softmax(df, ["i", "pos"]).collect():
        assert r.logp == pytest.approx(want(r.i, r.pos)[r.token_id], abs=1e-9)
    labels = spark.createDataFrame([(i, p, (i + p) % 9) for i in range(3) for p in range(5)] + [(1, 9, 0)], "i int, pos int, token_id long")
    got = {(r.i, r.pos): r for r in L.gathered_logps(df, labels, ["i"]).collect()}
    for i in range(3):
        assert (i, 0) not in got
        for p in range(1, 5):
            assert got[i, p].logp == pytest.approx(want(i, p - 1)[(i + p) % 9], abs=1e-9) and got[i, p].mass == pytest.approx(1)
    assert got[1, 9].logp is None  # no logits stand before it


def test_back_off_sums_to_one(spark):
    rng = random.Random(8)
    pairs = [(rng.choice("aab"), rng.choice("abcd")) for _ in range(40)] + [("z", "a")]
    model = L.BackOff(spark.createDataFrame(pairs, "prev string, token string"))
    tokens = sorted({t for _, t in pairs})
    rows = spark.createDataFrame([(p, t) for p in ("a", "b", "z", "never") for t in (*tokens, "unknown")], "prev string, token string")
    total = {}
    for r in model.score(rows).collect():
        total[r.prev] = total.get(r.prev, 0) + math.exp(r.logp)
    assert total == {p: pytest.approx(1) for p in ("a", "b", "z", "never")}
    empty = L.BackOff(spark.createDataFrame([], "prev string, token string")).score(spark.createDataFrame([("a", "b")], "prev string, token string"))
    assert empty.first().logp == pytest.approx(0)
    with pytest.raises(ValueError):
        L.BackOff(rows, 1.0)


def test_increments_survive_kills_and_repeats(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    table = J.Increments(spark, str(tmp_path / "t"), schema, "k")
    rows = lambda v, *ks: spark.createDataFrame([(k, v) for k in ks], schema)
    assert table.rows().count() == 0
    assert table.append("one", rows("a", 1, 1, 2))
    left = tmp_path / "t" / "rows" / "two"
    left.mkdir()
    (left / "part-0.json").write_text('{"k": 9, "v": "half a ro')  # what a killed run leaves
    assert sorted(map(tuple, table.rows().collect())) == [(1, "a"), (2, "a")]
    again = J.Increments(spark, str(tmp_path / "t"), schema, "k")
    assert not again.append("one", rows("b", 5)) and again.append("two", rows("b", 2, 3, 3))
    assert sorted(map(tuple, again.rows().collect())) == [(1, "a"), (2, "a"), (3, "b")]
    assert again.append("empty", rows("c")) and again.rows().count() == 3
    with pytest.raises(ValueError):
        again.append("../x", rows("c", 7))
    path = str(tmp_path / "plain")
    J.append_missing(rows("a", 1, 1), path, "k")
    J.append_missing(rows("b", 1, 2, 2), path, "k")
    assert sorted(map(tuple, J.read_jsonl(spark, path, schema).collect())) == [(1, "a"), (2, "b")]


def test_a_cache_asks_once_and_failures_again(spark, tmp_path):
    log = tmp_path / "asked"

    def provider(prompts):
        before = log.read_text().splitlines() if log.exists() else []
        with log.open("a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [(None, "down") if p == "never" or p == "flaky" and p not in before else (p.upper(), None) for p in prompts]

    q = V.ask(spark.createDataFrame([("a",), ("a",), ("flaky",), ("never",)], "prompt string"), 2).coalesce(1)
    got = V.cached(q, provider, str(tmp_path / "cache")).collect()
    assert sorted((r.prompt, r.sample_no, r.completion) for r in got) == sorted([("a", n, "A") for n in (1, 2)] * 2 + [("flaky", n, "FLAKY") for n in (1, 2)] + [("never", n, None) for n in (1, 2)], key=str)
    assert all((r.error is None) == (r.prompt != "never") for r in got)
    asked = log.read_text().splitlines()
    assert asked.count("a") == 2 and asked.count("flaky") == 4 and asked.count("never") == 4
    log.write_text("")
    assert V.cached(q.where("prompt <> 'never'"), provider, str(tmp_path / "cache")).where("error is null").count() == 6
    assert log.read_text() == ""


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_may_arrive_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rates = {k: [rng.choice([0.0, 0.2, 0.5, 0.8, 1.0, 1.5]) for _ in range(rng.randint(1, 6))] for k in range(40)}
    events = [(k, i, len(q), x) for k, q in rates.items() for i, x in enumerate(q)]
    rng.shuffle(events)
    events += [(k, i, n, 0.123) for k, i, n, _ in events[:30]]  # late repeats change nothing
    schema = "key int, k int, n int, rate double"
    for b in range(3):
        spark.createDataFrame(events[b::3] if b < 2 else events[2::3], schema).coalesce(1).write.json(str(tmp_path / "in" / f"b={b}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    z = streaming.localise_arriving(stream, "key")
    z.writeStream.format("memory").queryName(f"arrived{seed}").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.key: (r.first_error, round(r.confidence, 9)) for r in spark.table(f"arrived{seed}").collect()}
    first = {}
    for e in [e for b in range(3) for e in events[b::3]]:
        first.setdefault(e[:2], e[3])
    batch = spark.createDataFrame([(k, [first[k, i] for i in range(len(q))]) for k, q in rates.items()], "key int, q array<double>").select("key", S.localize(F.col("q")).alias("z"))
    assert spark.table(f"arrived{seed}").count() == 40 and got == {r.key: (r.z.first_error, round(r.z.confidence, 9)) for r in batch.collect()}


def test_arriving_rates_share_states(spark, tmp_path):
    """Keys of one state keep their own rates, marks and rows; a call of Python serves many keys."""
    rows = [(key, k, 3, [0.9, 0.8, 0.1][k] if key % 2 else 0.9) for k in (2, 0, 1) for key in range(300)]
    for i in range(3):
        spark.createDataFrame(rows[300 * i : 300 * i + 300], "key long, k int, n int, rate double").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    schema = spark.read.parquet(f"{tmp_path}/in0").schema
    z = streaming.arriving_rates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*"), "key", buckets=5)
    q = z.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet")
    q.awaitTermination()
    got = {r["key"]: r["rates"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {key: [0.9, 0.8, 0.1] if key % 2 else [0.9] * 3 for key in range(300)}
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"]) <= 5


def test_joins_by_span_bring_nothing_to_the_driver(spark):
    """Spans that an explode multiplied are not taken for small and broadcast."""
    from stepwright.operators import intervals

    toks = spark.range(3).select(F.col("id").alias("idx"), F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit(4).alias("end"))
    spans = spark.range(3).select(F.col("id").alias("idx"), F.lit(0).alias("k"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit(0.5).alias("w"))
    got = intervals.weights_by_span(toks, spans, ["idx"], 4)
    assert [r.w for r in got.collect()] == [0.5] * 3
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()


def test_running_sums_and_trims(spark):
    from stepwright.functions import text as X
    from stepwright.functions import tokens as K

    for n in (0, 1, 31, 32, 33, 64, 65, 500):
        q = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(q,)], "q array<int>").select(K.running_sums(F.col("q")).alias("s")).first().s
        assert got == [sum(q[: i + 1]) for i in range(n)]
    odd = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    row = spark.createDataFrame([(f"{odd}a{odd}b{odd}",)], "t string").select(X.strip(F.col("t")).alias("s"), X.rstrip(F.col("t")).alias("r"), K.scan(F.col("t")).alias("k")).first()
    assert row.s == f"a{odd}b" and row.r == f"{odd}a{odd}b"
    assert [(t.token, t.start, t.end) for t in row.k] == [("a", len(odd), len(odd) + 1), ("b", 2 * len(odd) + 1, 2 * len(odd) + 2)]


def test_small_counts_are_broadcast_and_large_ones_are_not(spark, monkeypatch):
    from stepwright.operators import scores

    toks = spark.createDataFrame([("a",), ("b",), ("a",)], "token string")
    plan = lambda: scores.unigram_scores(toks, scores.unigram_counts(toks), {"p": 1.0})._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(scores, "LOOKUP_ROWS", 1)
    assert "SortMergeJoin" in plan()


def test_tokens_without_places_and_ids_by_first_place(spark):
    """Offsets are neither stored nor, but for weights, computed; ids take no sort of all tokens and go to tokens without a shuffle."""
    from stepwright.plans import catalogue, localisation as Z

    text = "  one  two\x1cthree "
    row = [(1, text, "a b", "b c", ["b", "c"], [0.5, 1.0], "b"), (2, "", "é a", "", [""], [1.0], None)]
    df = spark.createDataFrame(row, "idx long, prompt string, chosen string, rejected string, rejected_steps array<string>, step_weights array<double>, positive_prefix string")
    full, bare = Z.token_table(df, "idx"), Z.token_table(df, "idx", places=False)
    assert bare.columns == ["idx", "side", "pos", "token", "w"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, full.drop("start", "end").collect()))
    alone = sorted((r.side, tuple(r.s)) for r in Z.token_words(df).collect())
    assert alone == sorted((r.side, tuple(t["token"] for t in r.toks)) for r in Z.token_lists(df, "idx").collect() if r.side != "positive")
    ids = catalogue._token_ids(bare)
    order = sorted((min((r.idx, r.side, r.pos) for r in bare.collect() if r.token == t), t) for t in {r.token for r in bare.collect()})
    assert {r.token: r.token_id for r in ids.collect()} == {t: i + 3 for i, (_, t) in enumerate(order)}
    assert "SortMergeJoin" not in Z.training_rows(df, "idx", ids, toks=bare)._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" in Z.training_rows(df, "idx", ids, toks=bare)._jdf.queryExecution().optimizedPlan().toString()
