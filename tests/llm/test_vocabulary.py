"""Spelling variants, source divergence and the Jaccard join against SQL, brute force and planted cases."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("stepwright.llm")
import duckdb  # noqa: E402
import numpy as np  # noqa: E402
from helpers import ROWS, docs, frame  # noqa: E402

from stepwright.llm import divergence, setjoin, spelling  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def from_sql(sql, df, columns):
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "lang", "source").toPandas()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [[None if x is None or x != x else x for x in r] for r in documents.astype(object).values.tolist()])
    rel = con.execute(sql)
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    return Counter(tuple(r[i] for i in at) for r in rel.fetchall())


# --- spelling


def brute_words(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    n, out = brute_words(rows), []
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


def spelled(spark, df):
    return Counter(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_neighbours_are_all_words_one_edit_away_and_none_twice():
    rng = random.Random(3)
    for _ in range(40):
        words = list({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(12)})
        own, near = spelling.neighbours(words, "abé", lambda h: np.arange(len(h)))
        pairs = list(zip(own, near))
        assert len(pairs) == len(set(pairs))
        for i, w in enumerate(words):
            want = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abé"} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abé"}
            assert {v for j, v in pairs if j == i} == want - {w}
    long = "ab" * 3000  # more places than fit one batch
    own, near = spelling.neighbours([long], "".join(map(chr, range(97, 97 + 26))) * 30, lambda h: np.arange(0, len(h), 999_983))
    assert all(abs(len(v) - 6000) <= 1 for v in near)


def test_hashes_of_neighbours_are_those_of_the_words():
    words = ["abcde", "ééabc", "aaaaa", "zzzzzz"]
    table = set(spelling.hashes(["abcd", "abcdef", "abXde", "eéabc", "aaaa", "aaaaaa", "zzzzz"]).tolist())
    own, near = spelling.neighbours(words, "abcdefXzé", lambda h: np.flatnonzero([x in table for x in h.tolist()]))
    assert set(zip(own, near)) == {(0, "abcd"), (0, "abcdef"), (0, "abXde"), (1, "eéabc"), (2, "aaaa"), (2, "aaaaaa"), (3, "zzzzz")}


def test_variants_match_brute_force(spark, sf):
    planted = [("kettle", 40), ("kettles", 19), ("kettel", 3), ("ketle", 12), ("kettly", 20), ("bottle", 5), ("bottles", 5), ("battle", 5), ("éclair", 8), ("eclair", 4), ("x" * 3000, 9), ("x" * 2999, 3), ("abcd", 50), ("once", 1)]
    rows = [(i, (w.upper() if i % 2 else w) + " ;", "en", "a", 1) for w, n in planted for i in range(n)] + ROWS
    df = frame(spark, rows)
    want = brute_variants(rows)
    assert spelled(spark, df) == want and {w: r for w, _, r, *_ in want}["ketle"] == "kettle"
    assert spelled(spark, df.limit(0)) == Counter()
    big = docs(spark, sf)
    got = spelled(spark, big)
    assert got == from_sql(spelling.ORACLE, big, ("word", "form", "root", "n", "n_near", "form_n")) and len(got) > 500


def test_roots_of_long_chains_and_crowded_ends(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"s{i}", "w37") for i in range(300)] + [(f"t{i}", "w20") for i in range(50)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert len(got) == len(forms) and set(got.values()) == {"w37"}


# --- divergence


def audited(df):
    return Counter(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_matches_sql(spark, sf, monkeypatch):
    columns = ("lang", "source", "part", "item", "value", "rank")
    rng = random.Random(5)
    words = ["the", "of", "Éa", "éa", "z", "日本", "straße", *(f"w{c}" for c in "abcdefghij")]
    rows = [(i, " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 20))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ä", None]), 1) for i in range(240)]
    rows += [(900, "alone here", "xx", "a", 1), (901, None, "xx", "b", 1), (902, "", "yy", "a", 1), (903, "tie tie", "zz", "a", 1)] + ROWS
    df = frame(spark, rows)
    want = from_sql(divergence.ORACLE, df, columns)
    assert audited(df) == want and ("xx", "a", "pair", "b", 0, 1) in want and any(r[2] == "term" for r in want)
    for name, small in (("CHUNK_TERMS", 3), ("BLOCK", 2), ("HELD", 5), ("CHUNK_COUNTS", 4)):
        monkeypatch.setattr(divergence, name, small)
    assert audited(df) == want
    monkeypatch.undo()
    assert audited(df.limit(0)) == Counter()
    big = docs(spark, sf)
    assert audited(big) == from_sql(divergence.ORACLE, big, columns)


def test_shares_are_exact():
    for count, total in ((5, 5), (1, 3), (2 * 10**15 + 7, 9 * 10**15 - 1), (10**9, 10**9 + 1), (9 * 10**14, 9 * 10**15)):
        assert divergence.share(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * count // total]


# --- Jaccard join


def brute_sets(rows):
    own, out = [], []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        own.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= 85 * len(own[i] | own[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    for k, (i, *_) in enumerate(rows):
        low = min((rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None), default=None)
        out.append((i, len(own[k]), low if own[k] else i))
    return Counter(out)


def near_texts(rng, n, base, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: len(w) - rng.randint(1, 12)]
        out.append(" ".join(w))
    return out


def joined(df, **how):
    return Counter(tuple(r) for r in setjoin.near_copies(df, **how).collect())


def test_links_match_brute_force(spark, sf):
    rng = random.Random(11)
    groups = [[f"g{g}w{rng.randrange(400)}" for _ in range(size)] for g, size in enumerate((120, 120, 60, 12, 5))]
    shared = [f"shared{i}" for i in range(40)]
    texts = [t for g in groups for t in near_texts(rng, 40, g, 2)] + [" ".join([*(f"{k}q{i}" for i in range(50)), *shared]) for k in range(30)]
    rows = [(k * 7 % 1009, t, "en", "a", 1) for k, t in enumerate(texts)] + ROWS
    df = frame(spark, rows)
    want = brute_sets(rows)
    assert 1 < len({c for *_, c in want}) < len(rows) - 60, len({c for *_, c in want})
    for how in ({}, {"sample": 1, "light": 2}, {"sample": 1, "common": 3, "light": 8, "block_sets": 7}, {"light": 1, "block_shingles": 300}):
        assert joined(df, **how) == want
    assert joined(df.limit(0)) == Counter()
    big = docs(spark, sf)
    assert joined(big) == from_sql(setjoin.ORACLE, big, ("doc_id", "n_shingles", "component_id"))


@pytest.mark.parametrize("seed", range(6))
def test_skipping_and_derived_overlaps_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**62, 80).astype(np.uint64) for _ in range(3)]
    sets = []
    for _ in range(50):
        own = base[rng.integers(3)]
        own = np.concatenate([own[rng.random(80) > rng.choice([0.02, 0.1])], rng.integers(0, 2**62, rng.integers(0, 10)).astype(np.uint64)])
        sets.append(np.unique(own))
    linked = [[100 * (o := len(np.intersect1d(a, b))) >= 85 * (len(a) + len(b) - o) for b in sets] for a in sets]
    group = setjoin.Group(sets, 85)
    for x in rng.permutation(50).tolist():
        assert {y for y in range(50) if linked[x][y]} <= set(group.candidates(x).tolist())
        assert group.overlaps(x).tolist() == [len(np.intersect1d(sets[x], s)) for s in sets]
    for side in (None, rng.integers(0, 2, 50)):
        label = list(range(50))
        for x in range(50):
            for y in range(x):
                if linked[x][y] and (side is None or side[x] != side[y]):
                    label = [label[x] if v == label[y] else v for v in label]
        mine = list(range(50))
        for x, y in setjoin.linked(sets, 85, side):
            mine = [mine[x] if v == mine[y] else v for v in mine]
        assert [label.index(v) for v in label] == [mine.index(v) for v in mine]


def test_prefix_and_least_overlap():
    for n in range(1, 200):
        for m in range(n, 240):
            o = next((o for o in range(n + 1) if 100 * o >= 85 * (n + m - o)), None)
            assert (setjoin.least(n, m) == o) if o is not None else setjoin.least(n, m) > n
            if o is not None:  # linked sets share so many indexed shingles, whatever the order
                assert setjoin.indexed(n) - (n - o) >= 1 + n // setjoin.PER or setjoin.indexed(n) == n
        assert setjoin.prefix(n) == n - next(o for o in range(n + 1) if 100 * o >= 85 * n) + 1


