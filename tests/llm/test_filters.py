"""BPE, quality rules, exact dedup, SimHash, mixing and the pipeline against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("stepwright.llm")
from helpers import ROWS, SCHEMA, docs, frame  # noqa: E402

from stepwright.llm import bpe, exact, mixing, quality, registry, simhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in docs(spark, sf).collect()]


# --- BPE


def reference_encoding():
    import public_tokenizers as P

    return bpe.encoding(P.path(bpe.RANKS), P.PATTERN)


def test_bpe_matches_library_and_round_trips(spark, sf):
    enc = reference_encoding()
    for df in (frame(spark), docs(spark, sf)):
        got = sorted(map(tuple, bpe.round_trip(df).collect()), key=str)
        want = []
        for r in df.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_bpe_safe_cuts_change_nothing():
    enc = reference_encoding()
    texts = [r[1] or "" for r in ROWS] + ["a" * 300 + "1" * 300 + "'s" * 50 + " \n " * 40 + "x", "12ab34 " * 50, "''''s'll" * 40, "  \n\n\t a" * 60]
    for t in texts:
        for long in (1, 3, 10, 100):
            if len(t) < 5000:
                assert "".join(bpe.pieces(t, long)) == t
                assert bpe.encode(t, enc, long) == enc.encode_ordinary(t)


def test_bpe_encode_then_decode_tables(spark):
    back = bpe.decode_documents(bpe.encode_documents(frame(spark)))
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in ROWS)
    assert bpe.round_trip(frame(spark, [])).count() == 0


# --- quality


def brute_measures(t):
    words = WORD.findall(t)
    win = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_quality_measures_match_brute_force(spark, sf):
    for df in (frame(spark), docs(spark, sf)):
        got = Counter(tuple(r) for r in quality.ledger(df).select("doc_id", *quality.BASE).collect())
        assert got == Counter((r.doc_id, *brute_measures(r.text or "")) for r in df.collect())
    for t in ("a b c a b c a b c", "x x x x", "a b c d a b c", "p q"):
        assert quality.measure(t.encode())[:5] == brute_measures(t)


def test_quality_policy_ledger_and_filter_agree(spark, sf):
    df = docs(spark, sf)
    led = quality.ledger(df)
    for version in quality.POLICIES:
        kept = {r.doc_id for r in quality.apply_policy(led, version).where("kept").collect()}
        assert kept == {r.doc_id for r in quality.keep_documents(df, version).collect()}
    assert quality.keep_documents(df).columns == df.columns
    assert quality.keep_documents(frame(spark, [])).count() == 0


def test_quality_bits_of_one_text_are_the_ledgers(spark, sf):
    awkward = [(i, t, "en", "a", 1) for i, t in enumerate(("A B " * 40, "WOW!! " * 30 + "x " * 30, "#tag " * 60, "a\na\na\na\n", "a " * 60, "incomprehensibilities " * 60), 100)]
    df = docs(spark, sf).unionByName(spark.createDataFrame(awkward, SCHEMA))
    got = Counter((r.doc_id, r.fail_bits) for r in quality.ledger(df).collect())
    assert got == Counter((r.doc_id, quality.fail_bits((r.text or "").encode())) for r in df.collect())
    assert {i for _, bits in got for i in range(len(quality.RULES)) if bits >> i & 1} == set(range(len(quality.RULES)))


def test_quality_stage_keeps_what_the_oracle_keeps(spark, sf):
    import corpus_pipeline as P
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = Counter(con.execute(f"select doc_id from ({quality.ORACLE}) where kept").fetchall())
    out = P.stage_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert Counter((r.doc_id,) for r in out.collect()) == want


def test_quality_ablations_match_brute_force(spark, sf):
    led = quality.ledger(docs(spark, sf)).cache()
    bits = [r.fail_bits for r in led.collect()]
    for r in quality.ablations(led).collect():
        own = 1 << quality.RULE_NAMES.index(r.rule)
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(bool(b & own) for b in bits), sum(b == own for b in bits), sum(b in (0, own) for b in bits))


def test_quality_keeps_labelled_good_documents(spark, sf):
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.apply_policy(quality.ledger(docs(spark, sf))).collect()
    for r in rows:
        if lab.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept, r


# --- exact


def brute_exact(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_matches_brute_force_with_and_without_collisions(spark, sf, bits):
    for df in (frame(spark), docs(spark, sf)):
        got = exact.exact_groups(df, hash_bits=bits, bucket_keys=8)
        assert Counter(map(tuple, got.collect())) == brute_exact([(r.doc_id, r.text) for r in df.collect()])


def test_exact_empty_and_filter(spark, sf):
    assert exact.exact_groups(frame(spark, [])).count() == 0
    df = docs(spark, sf)
    want = {k[0] for k in brute_exact([(r.doc_id, r.text) for r in df.collect()]) if k[3]}
    got = exact.keep_first(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("op", [exact, simhash])
def test_keep_first_names_rows_by_key_and_text(spark, op):
    t = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    rows = [(1, t[0]), (2, t[1]), (2, t[0]), (2, t[1]), (3, t[1]), (None, t[1]), (None, t[2]), (None, t[2]), (4, None), (5, "")]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as raw", "2 as stays", "3 as _jk")
    out = op.keep_first(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, t[0]), (2, t[1]), (None, t[2]), (4, None)])


def test_stages_take_awkward_rows_and_empty_tables(spark, sf):
    import corpus_pipeline as P

    for df in (frame(spark), frame(spark, [])):
        for name, stage in P.STAGES:
            out = stage(spark, df, sf)
            assert name == "bpe" or out.columns == df.columns
            out.collect()


def split_buckets(hashes, bucket_keys):
    """Extendible hashing one key at a time: a full bucket splits, the directory doubles when it must."""
    depth, table = 0, [[0, set()]]  # by slot: the bucket's depth and keys
    for h in hashes:
        h %= 1 << 64
        while True:
            at = h >> (64 - depth) if depth else 0
            bucket = table[at]
            if len(bucket[1] | {h}) <= bucket_keys:
                bucket[1].add(h)
                break
            if bucket[0] == depth:
                table = [b for b in table for _ in range(2)]
                depth += 1
            d = bucket[0] + 1
            halves = [[d, {x for x in bucket[1] if (x >> (64 - d)) & 1 == k}] for k in (0, 1)]
            table = [halves[(i >> (depth - d)) & 1] if b is bucket else b for i, b in enumerate(table)]
    first = {}
    return depth, [(i, first.setdefault(id(b), i), b[0]) for i, b in enumerate(table)]


@pytest.mark.parametrize("crowd", [0, 40])
def test_directory_is_that_of_splitting_one_key_at_a_time(spark, crowd):
    import random

    rng = random.Random(crowd)
    keys = {rng.getrandbits(64) for _ in range(200)} | {(0x5B << 56) + rng.getrandbits(56) for _ in range(crowd)}
    for some in (set(), set(list(keys)[:3]), keys):
        df = spark.createDataFrame([(h - (1 << 64) if h >> 63 else h,) for h in some], "h long")
        table, depth = exact.directory(df, 8)
        assert (depth, sorted(map(tuple, table.collect()))) == split_buckets(some, 8)


def test_exact_answers_come_through_the_directory(spark, sf, tmp_path):
    texts = docs(spark, sf).selectExpr("doc_id as id", "xxhash64(text) as raw", "text as body", "xxhash64(text) as h")
    index = exact.build_index(texts, texts, str(tmp_path / "index"), bucket_keys=8)
    want = Counter(map(tuple, index.probe(texts.select("id", "raw", "h"), texts).collect()))
    assert want.total() == texts.count() and index.depth >= 3
    assert want == Counter(map(tuple, index.probe(texts.select("id", "raw", "h"), texts, hot_rows=1).collect()))
    wrong = spark.read.parquet(f"{index.path}/directory").selectExpr(f"slot ^ {1 << index.depth - 1} as slot", "bucket", "depth").collect()
    spark.createDataFrame(wrong, "slot long, bucket long, depth int").write.mode("overwrite").parquet(f"{index.path}/directory")
    assert index.probe(texts.select("id", "raw", "h"), texts).count() == 0


def test_hot_join_loses_no_row(spark):
    from stepwright.llm import common

    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) as k")
    table = common.checkpointed(rows.groupBy("k").count().where("k <> 7").withColumnRenamed("count", "n"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, rows.join(table, "k", how).collect()))
        assert want == Counter(map(tuple, common.hot_join(rows, table, ("k",), "n", ("id",), how, hot_rows=20).collect()))


# --- SimHash


def brute_fp(t, width=3):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids_fps):
    fps = sorted({f for _, f in ids_fps})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, f in ids_fps:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [(i, f, low.get(find(f))) for i, f in ids_fps]


def test_fingerprint_matches_brute_force(spark, sf):
    for t in [r[1] or "" for r in ROWS if r[0] != 7] + [r[1] for r in rows_of(spark, sf)[:40]]:
        assert simhash.fingerprint(t.encode()) == brute_fp(t)


@pytest.mark.parametrize("list_max", [64, 1])
def test_simhash_components_match_brute_force(spark, sf, list_max):
    for df in (frame(spark), docs(spark, sf)):
        got = simhash.near_duplicates(df, list_max=list_max)
        fps = [(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in df.collect()]
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == Counter(brute_components(fps))


@pytest.mark.parametrize("list_max", [64, 2])
def test_simhash_links_on_dense_fingerprints(spark, list_max):
    import random

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)] + [1 << 63, 0]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for c in centres for _ in range(30)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from stepwright.llm import common

    comp = {r.node % (1 << 64): r.root for r in common.components(simhash.links(df, list_max)).collect()}
    want = {f: c for _, f, c in brute_components([(f, f) for f in fps])}
    for a in fps:
        for b in fps:
            same = a == b or (a in comp and comp.get(a) == comp.get(b))
            assert same == (want[a] == want[b])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_tally_counts_shared_positional_bytes(spark):
    import random
    from math import comb

    rng = random.Random(11)
    base = rng.getrandbits(64)
    fps = [base] + [base ^ sum(rng.randrange(1, 256) << 8 * p for p in rng.sample(range(8), k)) for k in (1, 1, 2, 2, 3, 3, 4) for _ in range(4)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    post = simhash.postings(df)
    got = {(r.a, r.b): r.tally for r in simhash.tallied(post).collect()}
    for x in set(fps):
        for y in set(fps):
            a, b = (f - (1 << 64) if f >> 63 else f for f in (x, y))
            shared = sum((x >> 8 * p) & 255 == (y >> 8 * p) & 255 for p in range(8))
            assert got.get((a, b), 0) == (comb(shared, simhash.KEY_BYTES) if a < b else 0)
    assert simhash.MIN_TALLY == comb(6, 5) and post.count() == 56 * len(set(fps))


def test_fingerprint_of_a_very_long_text():
    t = "".join(f"w{i * i % 9973} " for i in range(40_000))
    assert simhash.fingerprint(t.encode()) == brute_fp(t)


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    from stepwright.llm import common

    df = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 200000) as text")  # a megabyte each
    got = [r.rows for r in common.map_texts(df, ("doc_id",), [("rows", "int")], lambda texts: [[len(texts)] * len(texts)]).collect()]
    assert len(got) == 40 and max(got) <= 9
    assert common.filter_texts(df, lambda t: len(t) == 1_000_000).count() == 40


# --- mixing


def test_targets_reshare_above_the_cap():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 50}
    t = mixing.targets(sizes)
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(1160) and all(t[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert t["c"] / t[None] == pytest.approx(1 / 5) or t[None] == 150
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def brute_targets(sizes):
    """The common level at which the weights, each cut at three times the size, use up all words."""
    from fractions import Fraction as Q

    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: Q((5, 2, 1)[i % 3]) for i, s in enumerate(order)}
    level = lambda x: sum(min(3 * Q(sizes[s]), x * w[s]) for s in order)
    total, marks = sum(map(Q, sizes.values())), sorted({Q(0), *(3 * Q(sizes[s]) / w[s] for s in order)})
    for a, b in zip(marks, marks[1:]):
        if level(a) <= total <= level(b):
            x = a + (total - level(a)) * (b - a) / (level(b) - level(a)) if level(b) > level(a) else a
            return {s: float(min(3 * Q(sizes[s]), x * w[s])) for s in order}
    return {s: 0.0 for s in order}


def test_targets_match_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 7, 100, 5000]) for s in rng.sample(["a", "b", "B", "é", "zz", "10", "9", None], rng.randint(1, 8))}
        assert mixing.targets(sizes) == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}, sizes


def test_split_quotas_are_exact_and_rerun():
    import numpy as np

    q = np.array([100, 3, 0, 57])
    a, again = (np.array([b for _, b in mixing.split_quotas(q, 7, 1)]) for _ in range(2))
    assert (a.sum(axis=0) == q).all() and (a == again).all() and (a >= 0).all()
    assert a.sum(axis=1).max() - a.sum(axis=1).min() <= 3
    groups = [np.array([100, 3]), np.array([0, 57]), np.array([0])]
    totals, shards = np.array([g.sum() for g in groups]), Counter()
    for g, own in enumerate(groups):
        got = list(mixing.split_quotas(own, 7, 1, totals, g))
        assert [s for s, _ in got] == sorted({s for s, _ in got}) and (sum(b for _, b in got) == own).all()
        shards.update({s: int(b.sum()) for s, b in got})
    assert set(shards) == set(range(7)) and max(shards.values()) - min(shards.values()) <= 3


def test_source_targets_are_the_targets(spark):
    for sizes in ({"a": 10, "b": 100, "c": 1000, None: 50}, {"é": 0, "z": 0}, {"a": 1, "B": 5000, "b": 7, "c": 7, "zz": 100, "é": 1}):
        order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
        df = spark.createDataFrame([(s, sizes[s], i) for i, s in enumerate(order)], "source string, source_size long, rank long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_mixing_of_many_sources_in_few_groups(spark, monkeypatch):
    """Groups share sources, no table is broadcast, sources and blocks are hot: what is taken stays the same."""
    from stepwright.llm import common

    hot = common.hot_join
    rows = [(i, " ".join(["w"] * (i % 23)), "en", None if i % 5 == 0 else "hot" if i % 2 else f"s{i % 41}", 0) for i in range(3000)]
    df = frame(spark, rows)
    want = mixing.allocation(df, block_words=100, shard_words=900)
    monkeypatch.setattr(common, "hot_join", lambda *a, **k: hot(*a, **k, hot_rows=20))
    few = mixing.allocation(df, block_words=100, shard_words=900, groups=3, broadcast_rows=0)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert Counter(map(tuple, want.select(cols).collect())) == Counter(map(tuple, few.select(cols).collect()))
    shard = Counter()
    for r in few.collect():
        shard.update({int(x): r.size for x in r.shards.split(",") if x})
    assert len(shard) == mixing.math.ceil(sum(len(r[1].split()) for r in rows) / 900)


def test_mixing_nears_targets_and_reruns_agree(spark, sf):
    for df in (docs(spark, sf), frame(spark)):
        got = mixing.allocation(df).collect()
        size, src, taken, target, biggest = Counter(), {}, Counter(), {}, Counter()
        by_id = {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in df.collect()}
        for r in got:
            s = by_id[r.doc_id, r.size]
            size[s] += r.size
            taken[s] += r.taken
            target[s] = r.target
            biggest[s] = max(biggest[s], r.size)
            assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert {s: pytest.approx(t) for s, t in brute_targets({s: size[s] for s in target}).items()} == target
        for s in target:
            assert abs(taken[s] - target[s]) <= 2 * biggest[s]
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.allocation(df.repartition(3)).collect()))
    assert mixing.allocation(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_mix_rows_are_the_allocation(spark, sf):
    df = docs(spark, sf)
    rows = mixing.allocation(df, shard_words=5000).collect()
    want = Counter({r.doc_id: r.taken // r.size for r in rows if r.taken})
    plan = mixing.Plan(df, shard_words=5000)
    where = Counter((r.doc_id, int(x)) for r in rows if r.shards for x in r.shards.split(","))
    assert plan.shards > 1 and set(x for _, x in where) == set(range(plan.shards))
    drawn = plan.draws(plan.stats).selectExpr("doc_id", "explode(draws.shard) as shard").collect()
    assert where == Counter(map(tuple, drawn))
    out = mixing.mix(df, shard_words=5000)
    from pyspark.sql import functions as F

    at = Counter((r.doc_id, r.p) for r in out.select("doc_id", F.spark_partition_id().alias("p")).collect())
    assert at == where and out.rdd.getNumPartitions() == plan.shards  # a task a shard
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == want


# --- oracles and pipeline


def test_a_stored_ledger_serves_other_limits(spark, sf):
    df = docs(spark, sf)
    led = quality.stored(df)
    strict = {"words": 80, "symbols": 20, "shortest": 3}
    got = {r.doc_id: r.fail_bits for r in quality.redrawn(led, **strict).collect()}
    for r in df.collect():
        m = dict(zip((*quality.BASE, *quality.MORE), quality.measure(r.text.encode())))
        assert got[r.doc_id] == sum(1 << i for i, (_, fails) in enumerate(quality.RULES) if fails(m, quality.LIMITS | strict))
    assert "text" not in led.columns and quality.redrawn(led).exceptAll(led).count() == 0
    with pytest.raises(ValueError):
        quality.redrawn(led, nothing=1)


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        rel = con.execute(sql)
        cols = [c[0] for c in rel.description]
        want = Counter(map(tuple, rel.fetchall()))
        got = Counter(map(tuple, registry.QUERIES[name](spark, sf).select(*cols).collect()))
        assert got == want, name


def brute_jaccard(texts, width=5, alike=80):
    """The smallest id reachable over pairs of so alike shingle sets."""
    words = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for i, w in words.items()}
    label, where = {i: i for i in texts}, {}
    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in where.get(s, ()))
        for j, both in met.items():
            if 100 * both >= alike * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    return label


def test_pipeline_matches_brute_force(spark, sf):
    import corpus_pipeline as P

    df = docs(spark, sf)
    rows = {r.doc_id: r.text for r in df.collect()}
    kept = {i: t for i, t in rows.items() if not quality.rejects(t.encode())}
    kept = {k[0]: kept[k[0]] for k in brute_exact(list(kept.items())) if k[3]}
    comps = brute_components([(i, simhash.fingerprint(t.encode())) for i, t in kept.items()])
    kept = {i: kept[i] for i, _, c in comps if i == c}
    kept = {i for i, c in brute_jaccard(kept).items() if i == c}
    left = df.where(df.doc_id.isin(sorted(kept)))
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.allocation(left).collect() if r.taken})
    out = P.run(spark, sf)
    assert Counter(r.doc_id for r in out.collect()) == want
    cols = df.columns
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, df, sf).columns == cols


def test_only_measured_sizes_are_broadcast(spark):
    """Posting lists, 56 rows for each fingerprint, are not taken for small by the planner."""
    from pyspark.sql import functions as F

    from stepwright.llm import common as C

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    rows = spark.range(100)
    many = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(56)))).groupBy("id", "k").agg(F.count("*").alias("n"))
    plan = lambda: rows.join(many, "id")._jdf.queryExecution().sparkPlan().toString()
    with C._tidy(spark):
        assert "BroadcastHashJoin" not in plan()
    assert "BroadcastHashJoin" in plan() and [spark.conf.get(n, None) for n in names] == before
    assert C.checkpointed(rows.join(many, "id")).count() == 5600
