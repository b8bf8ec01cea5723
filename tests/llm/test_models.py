"""URL filter, toxicity, line join, span dedup and licence scan against brute force or held-out rows."""

import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import groupby, permutations

import pytest
import xxhash

pytest.importorskip("stepwright.llm")
from helpers import LONG, ROWS, docs, frame  # noqa: E402

from stepwright.llm import licences, linejoin, linkrank, spans, toxicity  # noqa: E402

# --- URL filter

PAGES = [
    (1, "https://WWW.Example.com:80/en/x?y#z", '<a href="https://bad.net/es/1">x</a>'),
    (2, "http://bad.net/es/2", "<A HREF='//other.org/a'>"),
    (3, "http://other.org", None),
    (4, None, "<a href=http://bad.net>"),
    (5, "no scheme", ""),
    (6, "x://", "<a href='http://bad.net/fr/'>"),
    (7, "http://a.b.example.com/en/q", "<a href='https://other.org/'>"),
    (8, "http://bad.net/fr/2", ""),
    (9, "http://bad.net/de/2", ""),
    (9, "http://bad.net/de/2", ""),
    (None, "http://likesbad.org/#x", "<a href='http://bad.net/'> <a href='HTTP://BAD.NET/2'>"),
    (11, "a://b://c/d", ""),
    (12, "http://notexample.com?x", ""),
]


def brute_pages(rows, rounds=linkrank.ROUNDS, damping=linkrank.DAMPING):
    parsed, links, hosts = [], Counter(), set()
    for i, url, html in rows:
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), v == "block", h + p, v) for v, h, p in linkrank.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((i, host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else None))
        if host:
            hosts.add(host)
            for t in set(re.findall(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)", html or "")):
                if t.lower() != host:
                    links[host, t.lower()] += 1
    hosts |= {b for _, b in links}
    up = set()
    for h in hosts:
        parts = h.split(".")
        up |= {(".".join(parts[k:]), ".".join(parts[k + 1 :])) for k in range(len(parts) - 2)}
    for a, b in up:
        links[a, b] += 1
        links[b, a] += 1
    seed = {0: Counter(), 1: Counter()}
    n = Counter(h for _, h, *_ in parsed if h)
    for _, h, _, _, v in parsed:
        if h and v:
            seed[v == "block"][h] += 1 / n[h]
    score = {}
    for kind in (0, 1):
        e = links if kind == 0 else Counter({(b, a): w for (a, b), w in links.items()})
        total = Counter()
        for (a, _), w in e.items():
            total[a] += w
        base = {h: r * (1 - damping) for h, r in seed[kind].items()}
        rank = Counter(base)
        for _ in range(rounds):
            new = Counter(base)
            for (a, b), w in e.items():
                if rank[a]:
                    new[b] += rank[a] * damping * w / total[a]
            rank = new
        score[kind] = Counter({h: r / (1 - damping) for h, r in rank.items()})
    return [(i, h, p, r, v or ("block" if score[1][h] - score[0][h] >= linkrank.THRESHOLD else "allow"), round(score[0][h], 9), round(score[1][h], 9)) for i, h, p, r, v in parsed]


def test_urls_match_brute_force(spark, sf):
    from pyspark.sql import functions as F

    own = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    for df in (own, spark.read.parquet(f"{sf}/pages.parquet")):
        got = [(*tuple(r)[:5], round(r.trust, 9), round(r.distrust, 9)) for r in linkrank.judge(df).collect()]
        assert Counter(got) == Counter(brute_pages([(r.page_id, r.url, r.html) for r in df.collect()]))
    bad = {r.host: r for r in linkrank.judge(own).collect()}["likesbad.org"]
    assert bad.distrust > 0.1 and bad.trust == 0
    assert {r.host: r.verdict for r in linkrank.judge(own, threshold=0.1).collect()}["likesbad.org"] == "block"
    assert linkrank.judge(own.limit(0)).count() == 0


def test_urls_of_a_hub_a_cycle_and_a_very_long_host(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/'>" for h in hosts)
    long = ".".join(f"l{i}" for i in range(1200)) + ".net"
    rows = [(i, f"http://s{i}.org/", link("hub.org", "hub.org")) for i in range(60)]
    rows += [(100, "http://hub.org/", link("bad.net", *(f"s{i}.org" for i in range(30)))), (101, "http://bad.net/fr/", link("a.xyz")), (102, "http://a.xyz/", link("b.xyz")), (103, "http://b.xyz/", link("a.xyz", "dangling.xyz")), (104, f"http://{long}/es/", "")]
    rows += [(200 + i, "http://hub.org/p", "") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((*tuple(r)[:5], round(r.trust, 9), round(r.distrust, 9)) for r in linkrank.judge(df).collect())
    assert got == Counter(brute_pages(rows))


# --- toxicity


def test_toxicity_held_out(spark):
    import duckdb

    at = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, toxic from '{at}/labels.parquet'").fetchall()
    got = {r.doc_id: r for r in toxicity.query(spark, at).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    assert len(got) == 1000
    held = [(got[i].score, y) for i, y in rows if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.75 and sum(n >= 0.7 for n in neg) <= 0.03 * len(neg)


def _toxic(n=600, seed=2):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        s = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(5)]
        y = i % 4 == 0
        if y:
            k = rng.randrange(5)
            s[k] += " " + rng.choice(["vilea", "vileb", "vilec"])
        texts.append(". ".join(s) + ".")
        labels.append(int(y))
    return texts, labels


def test_toxicity_learns_sentences_from_document_labels(spark):
    texts, labels = _toxic()
    model = toxicity.fit(texts, labels)
    rows = [(1, "word1 word2. Word3 VILEA! word4."), (2, "word1 word2."), (3, None), (4, " \n "), (None, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as spans")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert got[1].score >= 0.7 > got[2].score and got[3].score == got[4].score == 0 and got[None].score < 0.7
    assert [rows[0][1][s.start : s.end] for s in got[1].spans] == ["Word3 VILEA!"]
    for labels in ([], [0] * 3, [1] * 3):
        assert 0 <= toxicity.fit(["a b"] * len(labels), labels).bias + 20


def test_toxicity_training_rows(spark):
    texts, labels = _toxic(300)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (5000, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, 0), (None, 1), (7, None), (5000, 1), (9999, 1)], "doc_id long, toxic int").selectExpr("*", "'s' as text")
    model = toxicity.train(df, lab)
    assert all(model.weights[w] > 3 for w in ("vilea", "vileb", "vilec"))
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.train(df.limit(0), lab).weights == {}


def test_scores_are_the_noisy_or_of_sentences(spark, sf):
    """Every score written out: one less the product over sentences of one less the sentence's chance."""
    import math

    texts, labels = _toxic()
    model = toxicity.fit(texts, labels)
    df = frame(spark).unionByName(frame(spark, [(600 + i, t, "en", "a", 1) for i, t in enumerate(texts[:40])]))
    want = Counter()
    for r in df.collect():
        rest = 1.0
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", r.text or ""):
            if sentence.strip():
                found = {w.strip(".,;:!?\"'()[]{}<>*#$%&|-_/\\") for w in sentence.lower().split()}
                found |= {"^" + w[:5] for w in found if len(w) > 5}
                z = model.bias + sum(model.weights.get(w, 0.0) for w in found)
                rest *= 1 - 1 / (1 + math.exp(-z))
        want[r.doc_id, round(1 - rest, 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(df, model).collect()) == want


def test_toxicity_of_repeated_rows_and_ties(spark):
    texts, labels = _toxic(200)
    rows = [(i, t) for i, t in enumerate(texts)] * 3 + [(0, "vilea"), (1, None)]
    df = frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    assert all(model.weights[w] > 2 for w in ("vilea", "vileb", "vilec"))
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.score) for r in got if r.doc_id > 1}) == len(texts) - 2


# --- line join


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def _mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        kind, i = rng.randrange(3), rng.randrange(len(s) + 1)
        if kind == 0:
            s.insert(i, rng.choice("abcé"))
        elif s:
            s[i % len(s) : i % len(s) + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(s)


def test_banded_distance_keys_and_sketches():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        b, k = _mutate(rng, a, rng.randrange(6)), rng.choice([1, 2, 3])
        d = edit_distance(a, b)
        assert linejoin.within(a, b, k) == (d <= k)
        if 3 < len(a) and 3 < len(b) and 0 < d <= k and d <= max(len(a), len(b)) // 5:
            short, long = sorted((a, b), key=len)
            one, two = linejoin.Batch(["zzzzzzzz", short, long]), linejoin.Batch([long, "yyyyyyy"])
            ours = [set(keys[line == i].tolist()) for x, i, probe in ((one, 1, False), (two, 0, True)) for line, keys in [x.keys(k, probe)]]
            assert ours[0] & ours[1]
            assert (int(one.sketches[1]) ^ int(two.sketches[0])).bit_count() <= 4 * k
            assert one.sketches[2] == two.sketches[0]


def plain_within(a, b, k):
    if max(len(a), len(b)) > 1000:  # common ends of very long lines don't matter
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[n:], b[n:]
        if max(len(a), len(b)) > 1000:
            return False
    return edit_distance(a, b) <= k


def test_long_lines_take_linear_time():
    import time

    rng = random.Random(2)
    a = "".join(rng.choice("abcd") for _ in range(400_000))
    took = []
    for n in (100_000, 400_000):
        b = "x" + a[1 : n - 1] + "y"
        start = time.process_time()
        assert linejoin.within(a[:n], b, 2) and not linejoin.within("zz" + a[2 : n - 1] + "w", b, 2)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5
    assert [e - s for s, e in linejoin.chunks(["a" * 6000] * 400 + ["b" * (1 << 21)] + ["c"])] == [174, 174, 52, 1, 1]


def line_name(t):
    return int.from_bytes(xxhash.xxh3_128_digest(t.encode())[:8], "big", signed=True)


def test_many_lines_that_share_a_segment(spark):
    tail = " and the very same words at the end of the line here"
    rows = [(i, f"{(i * 2654435761) % (1 << 32):08x} {(i * 40503) % 99991:05d}{i:06d}" + tail) for i in range(50_000)] + [(60_000, "deadbeef 99999 999999" + tail), (60_001, "deadbeef 99999 999998" + tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(sorted(x)) for x in linejoin.links(df).selectExpr("x.a", "y.a").collect()}
    assert tuple(sorted((line_name(rows[-1][1]), line_name(rows[-2][1])))) in found


def test_very_many_lines_that_are_all_alike(spark):
    import time

    base = "the same long line of a form that is filled in by very many with a place, a name and a date of its own"
    lines = sorted({base[:i] + chr(0x4E00 + k) + base[i + 1 :] for i in range(len(base)) for k in range(100)})  # any two are within two edits
    far = "no such " + base[8:40] + " but quite another end than all of the others have got here"
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, far])], "doc_id long, text string")
    start = time.time()
    got = linejoin.dedup(df).collect()
    took = time.time() - start
    assert sum(r.n_removed for r in got) == len(lines) - 1 and {r.n_links for r in got} == {0, len(lines) - 1}
    assert took < 150, took


def brute_lines(rows, edits=2):
    occ = [(i, t, p, x) for i, t in rows for p, x in enumerate([y for y in (t or "").split("\n") if y.strip(" \t\r\x0b\x0c")])]
    lines = sorted({x for *_, x in occ})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for x in lines:
        by[len(x)].append(x)
    for x in lines:
        for n in range(len(x), len(x) + edits + 1):
            for y in by[n]:
                if x < y if n == len(x) else True:
                    if x != y and plain_within(x, y, min(edits, max(len(x), len(y)) // 5)):
                        root[find(x)] = find(y)
    first, size = {}, Counter(map(find, lines))
    for i, t, p, x in sorted(occ, key=lambda o: (o[0] is None, o[0] or 0, o[2])):
        first.setdefault(find(x), (i, p))
    out = []
    for i, t in rows:
        own = [y for y in (t or "").split("\n") if y.strip(" \t\r\x0b\x0c")]
        at = [first[find(x)] for x in own]
        out.append((i, len(own), sum(f != (i, p) for p, f in enumerate(at)), sum(size[find(x)] - 1 for x in own), tuple(f[0] for f in at)))
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"crowd": 1}, {"crowd": 4}])
def test_line_join_matches_brute_force(spark, how):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(3, 60))) + "." for _ in range(16)]
    texts = ["\n".join(_mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    rows = [(i + 100, t) for i, t in enumerate(texts)] + [r[:2] for r in ROWS] + [(900, LONG + "!")]
    full = [(i, t, "en", "s", 1) for i, t in rows]
    df = frame(spark, full)
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.n_links, tuple(r.first_ids)) for r in linejoin.dedup(df, **how).collect())
    assert got == brute_lines(rows)
    assert linejoin.dedup(frame(spark, [])).count() == 0


def test_line_join_on_a_very_common_segment(spark):
    rng = random.Random(4)
    tail = "x" * 60
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(30)) + tail) for i in range(80)] + [(500, "a" * 30 + tail), (501, "a" * 29 + "b" + tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idx, prb = (linejoin._key_rows(df, "text", 2, 4, probe) for probe in (False, True))
    assert linejoin.met_pairs(idx, prb, 2).count() < 210  # of 3,321 pairs
    for crowd in (128, 8):
        assert Counter((r.doc_id, r.n_lines, r.n_removed, r.n_links, tuple(r.first_ids)) for r in linejoin.dedup(df, crowd=crowd).collect()) == brute_lines(rows)


def test_links_of_a_crowded_key_are_all_found(spark, monkeypatch):
    """Lines within two edits of each other, many to a key: every pair is a link, and a line's number of links is its own."""
    monkeypatch.setattr(linejoin, "BLOCK", 7)
    base = "the same long line of a form that is filled in by many"
    lines = sorted({base[:i] + chr(0x61 + k) + base[i + 1 :] for i in range(0, 54, 6) for k in range(6)} | {base[:5] + base[9:30] + x + base[30:] for x in ("", "q", "qr", "qrs", "qrst")})
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    near = {(p, q) for p in lines for q in lines if p < q and edit_distance(p, q) <= 2}
    for crowd in (4, 128):
        got = [tuple(sorted(x)) for x in linejoin.links(df, crowd=crowd).selectExpr("x.a", "y.a").collect()]
        assert len(got) == len(near) and set(got) == {tuple(sorted((line_name(p), line_name(q)))) for p, q in near}
        some = linejoin.joining(df, crowd=crowd).count()
        assert some < len(near) if crowd == 4 else some == len(near)
        count = {r.doc_id: r.n_near for r in linejoin.dedup(df, every=True, crowd=crowd).collect()}
        assert count == {i: sum(x in pair for pair in near) for i, x in enumerate(lines)}


def test_line_texts_keep_the_rest(spark):
    rows = [(1, "the very same long line of text\n\nother words that stand only here ok"), (2, "intro\nthe very same long line of texts\n\nend")]
    got = {r.doc_id: r.text for r in linejoin.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "intro\n\nend"}


# --- spans


def plain_runs(text):
    """Words, ends of pieces and runs as word ranges, written out word by word."""
    import xxhash

    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    words = [m[0] for m in found]
    n = len(words)
    stop = {i + 1 for i, w in enumerate(words) if w[-1] in ".!?" or i == n - 1}
    lines = {i + 1 for i in range(n - 1) if "\n" in text[found[i].end() : found[i + 1].start()]}
    ends, out = set(), set()
    for sentence_ends in (stop, stop | lines):
        cuts, at = set(sentence_ends), 0
        for e in sorted(sentence_ends):
            for i in range(at, e - 8):
                cuts.add(1 + min(range(i, i + 9), key=lambda k: (xxhash.xxh32_intdigest(words[k]), -k)))
            at = e
        marks = [0, *sorted(cuts)] if n else []
        ends |= cuts
        long = lambda x, y: marks[y] - marks[x] >= 25 and y - x >= 3  # noqa: E731,B023
        for x in range(len(marks)):
            out |= {(marks[x], marks[min(y for y in range(x, len(marks)) if long(x, y))])} if any(long(x, y) for y in range(x, len(marks))) else set()
            out |= {(marks[max(y for y in range(x) if long(y, x))], marks[x])} if any(long(y, x) for y in range(x)) else set()
    return words, sorted(ends), sorted(out) or [(0, n)] * bool(n)


def brute_spans(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    table = [plain_runs(t) for _, t in rows]
    first, made = {}, []
    for keyed in groupby(range(len(rows)), key=lambda k: rows[k][0]):
        own = list(keyed[1])
        made.append(own)
    count = Counter(tuple(words[i:j]) for words, _, out in table for i, j in out)
    result = []
    for own in made:
        # which of the rows that share a key is first is left open: any order of theirs may be met
        best = []
        for order in permutations(own):
            seen, res = set(first), []
            for k in order:
                words, ends, out = table[k]
                gone = set()
                for i, j in out:
                    run = tuple(words[i:j])
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
                bad = [(a, b) for a, b in zip([0, *ends], ends) if set(range(a, b)) <= gone]
                res.append((rows[k][0], len(ends), len(bad), sum(b - a for a, b in bad)))
            best.append(Counter(res))
        result.append(best)
        first.update((tuple(table[k][0][i:j]), None) for k in own for i, j in table[k][2])
    assert count
    return result


def agrees(got, want):
    """Whether some order of the rows that share a key gives these results."""
    left = Counter(got)
    for best in want:
        fit = next((c for c in best if not c - left), None)
        if fit is None:
            return False
        left -= fit
    return not left


def test_spans_match_brute_force(spark, sf):
    own = frame(spark).where("doc_id is null or doc_id <> 7")  # the very long text has a test of its own
    for df in (own, docs(spark, sf)):
        got = [(r.doc_id, r.n_sentences, r.n_removed, r.removed_words) for r in spans.cut(df).collect()]
        assert agrees(got, brute_spans([(r.doc_id, r.text) for r in df.collect()]))
    assert spans.cut(frame(spark, [])).count() == 0


def test_spans_of_rows_that_share_a_key_and_of_equal_rows(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage, short = say(60), "Two short sentences. No more than that."
    rows = [(1, say(40) + " " + passage), (1, say(50) + " " + passage), (2, passage), (2, passage), (2, passage), (None, passage + " " + say(9)), (3, short), (4, short), (5, short), (6, "ok"), (7, "ok"), (7, "ok"), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"sample": 1, "hot_rows": 1}):
        got = [(r.doc_id, r.n_sentences, r.n_removed, r.removed_words) for r in spans.cut(df, **how).collect()]
        assert agrees(got, brute_spans(rows))
        assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)
        assert sum(r[2] > 0 for r in got if r[0] == 1) == 1 and all(r[2] for r in got if r[0] in (2, 4, 5, 7)) and not any(r[2] for r in got if r[0] in (3, 6, 8))


def test_spans_split_common_runs_alike(spark, sf):
    df = docs(spark, sf)
    rows = lambda **how: Counter((r.doc_id, r.n_removed, r.text) for r in spans.cut(df, places=False, **how).collect())
    assert rows() == rows(sample=1, hot_rows=1)


def test_spans_take_very_long_texts(spark):
    df = spark.createDataFrame([(1, LONG), (2, LONG), (3, "é " + LONG)], "doc_id long, text string")
    got = {r.doc_id: r for r in spans.cut(df).collect()}
    assert got[2].n_removed == got[2].n_sentences and got[2].text == "" and got[3].text.split()[:1] == ["é"]
    assert [(r.start, r.end) for r in got[2].removed] == [(0, len(LONG))] and got[3].removed[-1].end == len(LONG) + 2


def test_runs_cover_and_are_long_enough():
    rng = random.Random(1)
    for _ in range(300):
        s = [(0, 0, rng.randrange(1, 20)) for _ in range(rng.randrange(12))]
        got = spans.runs(s)
        n = [x[2] for x in s]
        if len(s) < 3 or sum(n) < 25:
            assert got == ([(0, len(s) - 1)] if s else [])
        else:
            assert all(j - i + 1 >= 3 and sum(n[i : j + 1]) >= 25 for i, j in got) and len(set(got)) == len(got)
            assert {k for i, j in got for k in range(i, j + 1)} == set(range(len(s)))


@pytest.mark.parametrize("stop", [".", ""])
def test_spans_find_planted_passages(spark, stop):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) + (stop if rng.random() < 0.15 else "") for _ in range(n))
    passage = say(80)
    rows = [(i, say(120) + (f"\n{passage}\n" if i in (3, 7, 9) else "\n") + say(100)) for i in range(12)]
    got = {r.doc_id: r for r in spans.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, r in got.items():
        if i in (7, 9):
            assert 60 <= r.removed_words <= 80 and len(r.text.split()) == 300 - r.removed_words
        else:
            assert r.n_removed == 0 and r.text == rows[i][1]
    assert " ".join(rows[7][1][r.start : r.end] for r in got[7].removed).split() == passage.split()[80 - got[7].removed_words :] or got[7].removed_words >= 60


def run_texts(text):
    body = text.encode()
    s = spans.sentences(body)
    return {b" ".join(body[s[i][0] : s[j][1]].split()) for i, j in spans.runs(s)}


@pytest.mark.parametrize("stop", [0, 0.05, 0.15])
def test_spans_find_any_51_words_wherever_they_stand_and_however_wrapped(spark, stop):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    say = lambda n: [rng.choice(vocab) + ("." if rng.random() < stop else "") for _ in range(n)]
    for trial in range(300):
        passage, wrap = say(51), rng.randrange(5, 15)
        one = " ".join([*say(rng.randrange(40)), *passage, *say(rng.randrange(40))])
        words = [*say(rng.randrange(40)), *passage, *say(rng.randrange(40))]
        two = "\n".join(" ".join(words[k : k + wrap]) for k in range(0, len(words), wrap)) if trial % 2 else " ".join(words)
        common = run_texts(one) & run_texts(two)
        assert any(len(r.split()) >= 25 and r in " ".join(passage).encode() for r in common)
        assert not run_texts(one) & run_texts(" ".join(say(150)))
    rows = [(1, one), (2, two), (3, " ".join(say(150)))]
    got = {r.doc_id: r.removed_words for r in spans.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == 0 and 34 <= got[2] <= 51


def test_spans_find_repeated_lines_whole():
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    lines = "\n".join(say(9) for _ in range(3))
    common = run_texts(f"{say(20)}\n{lines}\n{say(20)}") & run_texts(f"{say(30)}\n{lines}\n{say(30)}")
    assert " ".join(lines.split()).encode() in common


# --- licences


def test_licences_are_found_and_clean_text_is_not(spark, sf):
    notice = re.compile(r"(?i)licen[sc]e|rights reserved")
    df = docs(spark, sf)
    model = licences.train(df)
    rows = {r.doc_id: r.text for r in df.collect()}
    for r in licences.scan(df, model).collect():
        t = rows[r.doc_id]
        want = sorted((a, b) for a, b in licences.paragraphs(t) if notice.search(t[a:b]))
        assert [(m.start, m.end) for m in r.matches] == want
    extra = [
        (1, "x\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\ny", "apache"),
        (2, "Some tale of an apache and a version of the public", ""),
        (3, "Released under the MIT License. All the best", "mit"),
        (4, None, ""),
        (5, "", ""),
        (None, LONG, ""),
        (7, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above notice appears", "isc"),
        (8, "This is free and unencumbered software released into the public domain.\nand so on", "unlicense"),
        (9, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0\nwhich is available", "epl"),
        (6, "Licensed under the GNU Lesser General Public License, version 2.1.\nAll rights reserved.", "lgpl,reserved"),
    ]
    own = spark.createDataFrame([e[:2] for e in extra], "doc_id long, text string").selectExpr("*", "1 as matches")
    got = {r.doc_id: ",".join(m.family for m in r.matches) for r in licences.scan(own, model).collect()}
    assert got == {e[0]: e[2] for e in extra}
    assert licences.scan(own.limit(0), licences.train(own.limit(0))).count() == 0


def test_bundles_of_notices_take_linear_time_and_match_window_by_window(spark, sf):
    import time

    model = licences.train(docs(spark, sf))
    notices = [t for v in licences.TEMPLATES.values() for t in v]
    lines = [x for i in range(6000) for x in (notices[i % len(notices)], f"the license under the terms of some public version 2.0 {i}", "")]
    start = time.process_time()
    found = model.find("\n".join(lines))
    assert time.process_time() - start < 20 and len(found) >= 6000  # a megabyte
    known, words = model.known, [licences.tokens(x) for x in lines[:90]] + [licences.tokens(w) for w in notices[1].split()]
    warm = known.warm(words)
    got = {(i, j): o for i, j, o in known.windows(words, warm, known.ends(words))}
    for i in range(len(words)):
        for j in range(i + 1, min(i + 5, len(words))):
            if all(words[i : j + 1]):
                own = {g for g in licences.grams([w for ws in words[i : j + 1] for w in ws]) if g in known.of}
                if (i, j) in got:
                    assert got[i, j] == own
                elif any(warm[i : j + 1]) and sum(map(len, words[i + 1 : j])) < known.longest:
                    assert known.share(own) < licences.LEAST_MATCH


def test_background_is_chosen_by_hash_of_the_text():
    seen = sorted(["short", "long " * 50, "middle one", "another line"], key=licences._by_hash)
    assert seen == sorted(reversed(seen), key=licences._by_hash) and [len(x) for x in seen] != sorted(map(len, seen))


def test_licence_model_is_bounded_whatever_the_keys(spark):
    rows = [(None, "some plain words of one and the same text")] * 500 + [(6, f"plain text number {i} of many") for i in range(400)] + [(7, "x " * (1 << 18))]
    df = frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    import stepwright.llm.licences as L

    seen = []
    fit, L.fit = L.fit, lambda parts: seen.append(parts)
    try:
        L.train(df, max_docs=50)
    finally:
        L.fit = fit
    assert 10 <= len(seen[0]) <= 120 and max(map(len, seen[0])) < 100


def test_licence_probabilities_match_brute_force(spark, sf):
    """Weights of a paragraph's n-grams summed and normalised, one n-gram after another."""
    import math

    model = licences.train(docs(spark, sf))
    for text in ("Released under the MIT License.", "the terms of the version 2.0", "no such words here", "All rights reserved. All rights reserved."):
        words = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
        own = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        known = [g for g in own if g in model.weights]
        z = [(b + sum(model.weights[g][f] for g in known) / math.sqrt(max(1, len(known)))) / model.heat for f, b in enumerate(model.bias)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        assert model.probabilities(known) == pytest.approx(p)
        family, chance, match = model.predict(text)
        best = licences.FAMILIES[max(range(len(p)), key=p.__getitem__)]
        assert family == (best if p[licences.FAMILIES.index(best)] >= 0.5 and match >= 0.6 else "unknown")


NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


@pytest.mark.parametrize("mark", ["", "# "])
def test_licences_wrapped_over_lines_are_found_once(spark, sf, mark):
    model = licences.train(docs(spark, sf))
    rows, want = [], {}
    for family, notice in NOTICES.items():
        for width in (30, 60, 70, 72, 76, 80):
            head = "\n".join(mark + x for x in textwrap.wrap(notice, width))
            want[len(rows)] = family
            rows.append((len(rows), f"import this\n\n{head}\n{mark}\nx = 1\n"))
    rows += [(100, "The terms of the peace were free to\nmodify, for the general public and\nthe use of all rights in every form"), (101, "Version 2.0\nthe following conditions\n\nare met")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licences.scan(own, model).collect():
        assert [m.family for m in r.matches] == ([want[r.doc_id]] if r.doc_id in want else [])
        for m in r.matches:
            cut = rows[r.doc_id][1][m.start : m.end]
            assert " ".join(cut.replace("# ", "").split()[:8]) == " ".join(NOTICES[m.family].split()[:8])


def test_a_line_counts_by_its_own_ngrams(spark, sf):
    model = licences.train(docs(spark, sf))
    line = "it under the terms of the GNU General Public License as published by"
    family, p, match = model.predict(line)
    assert family == "gpl" and p >= 0.5 and match >= 0.6
