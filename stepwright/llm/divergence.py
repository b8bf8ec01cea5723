"""Source divergence audit over integer-dictionary encoded term counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

#: ASCII letters and whatever is not ASCII; in UTF-8 these are the bytes from 0x80 on.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A term stays in a language with so many documents; smoothing of each term; scale of the shares; ranks of terms.
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 10**9, 50
#: Term counts held by a task before they move on; terms and counts of a chunk at most; sources in one dense block.
HELD, CHUNK_TERMS, CHUNK_COUNTS, BLOCK = 400_000, 4096, 1 << 18, 128


def counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term binary, n, docs``: occurrences and documents of each term by group, nulls as ''.

    Each group also has one row with a null term, for groups without terms.  Tasks combine their counts
    and pass them on whenever they hold ``HELD`` of them.
    """
    C.small_batches(docs.sparkSession)
    src = C.pick(docs, lang, source, text).select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("binary").alias("body"))
    schema = T._parse_datatype_string("lang string, source string, term binary, n bigint, docs bigint")
    arrow = to_arrow_schema(schema)

    def rows(n, docs):
        for group, own in n.items():
            own[None] += 0
            terms = list(own)
            cols = [[group[0]] * len(terms), [group[1]] * len(terms), terms, list(own.values()), [docs[group][t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches):
        n, docs, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for group in zip(*(batch.column(i).to_pylist() for i in range(3))):
                terms = TERM.findall((group[2] or b"").lower())
                own = n[group[:2]]
                held -= len(own)
                own.update(terms)
                held += len(own)
                docs[group[:2]].update(set(terms))
                if held >= HELD:
                    yield from rows(n, docs)
                    n.clear()
                    docs.clear()
                    held = 0
        yield from rows(n, docs)

    part = src.mapInArrow(run, schema)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def encode(kept: DataFrame) -> DataFrame:
    """``lang, terms, sources, own, ids, counts`` of ``kept(lang, source, term, n)``: one row for each chunk of the dictionary.

    Terms are dealt by range of (lang, term) in UTF-8 order, so a task's kept terms, sorted, are a stretch
    of the dictionary, cut into chunks.  Counts are encoded by their term's place in the sorted array
    (``ids``) and their source's place in ``sources`` (``own``).
    """
    schema = T._parse_datatype_string("lang string, terms array<binary>, sources array<string>, own array<int>, ids array<int>, counts array<bigint>")
    arrow = to_arrow_schema(schema)

    def chunk(lang, rows):
        terms = np.array(sorted({r[0] for r in rows}) + [None], object)[:-1]  # an object array whatever the lengths
        sources = sorted({r[1] for r in rows})
        place = {s: i for i, s in enumerate(sources)}
        ids = np.searchsorted(terms, np.array([r[0] for r in rows] + [None], object)[:-1])
        cols = [[lang], [terms.tolist()], [sources], [[place[r[1]] for r in rows]], [ids.tolist()], [[r[2] for r in rows]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches):
        held, lang, term, n = [], None, None, 0
        for batch in batches:
            for at, source, word, count in zip(*(c.to_pylist() for c in batch.columns)):
                if (at, word) != (lang, term):
                    if held and (at != lang or n >= CHUNK_TERMS or len(held) >= CHUNK_COUNTS):
                        yield chunk(lang, held)
                        held, n = [], 0
                    lang, term, n = at, word, n + 1
                held.append((word, source, count))
        if held:
            yield chunk(lang, held)

    rows = kept.select("lang", "source", "term", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return rows.mapInArrow(run, schema)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)`` in whole numbers, three digits at a time; totals up to 9 * 10^15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):  # rest < total, so each step gives three digits; a total is at least the count
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def compare(width, own, ids, found, totals, v, top: int = TOP):
    """One chunk of ``width`` dictionary terms: ``(a, b, value)`` with the summed differences of its terms for
    all sources a < b of the language, and ``(a, id, value)`` with each source's best terms.

    ``own, ids, found`` are source, term and occurrences of each count, ``totals`` the kept occurrences of
    all sources, ``v`` the language's kept terms.  Vectors are dense over the chunk's ids, for a block of
    sources at a time; ids are in UTF-8 order, so they break ties.
    """
    n = len(totals)
    full = totals + SMOOTH * v

    def dense(lo):
        mine = (own >= lo) & (own < lo + BLOCK)
        cells = np.zeros((min(BLOCK, n - lo), width), np.int64)
        cells[own[mine] - lo, ids[mine]] = found[mine]
        return cells, share(cells + SMOOTH, full[lo : lo + BLOCK, None]) if width else cells

    both = np.zeros(width, np.int64)
    np.add.at(both, ids, found)
    mean = share(both + SMOOTH, full.sum() - SMOOTH * v * (n - 1)) if width else both
    pairs, tops = [], []
    for lo in range(0, n, BLOCK):
        cells, p = dense(lo)
        for start in range(lo, n, BLOCK):
            q = p if start == lo else dense(start)[1]
            for i in range(len(p)):
                first = i + 1 if start == lo else 0
                values = np.abs(q[first:] - p[i]).sum(axis=1).tolist()
                pairs += [(lo + i, start + first + j, x) for j, x in enumerate(values)]
        for i in range(len(p)):
            at = np.flatnonzero((cells[i] > 0) & (p[i] > mean))
            value = p[i, at] - mean[at]
            best = np.lexsort((at, -value))[:top]
            tops += [(lo + i, int(at[k]), int(value[k])) for k in best]
    return pairs, tops


def parts(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, term, value``: what each chunk gives for pairs (``other``) and for terms.

    ``groups`` has ``lang, sources array<struct<source,n>>, v``, a row a language, repeated by salt so that
    the chunks of one language are not gathered in a task.  Each language also gets one empty chunk, for
    groups without kept terms.
    """
    spark = chunks.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = groups.select("lang", *(F.array().cast(chunks.schema[c].dataType).alias(c) for c in ("terms", "sources", "own", "ids", "counts")))
    rows = chunks.unionByName(none).withColumn("salt", F.pmod(F.xxhash64("terms"), F.lit(salts)))
    table = groups.select("lang", F.col("sources").alias("every"), "v", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    met = rows.join(table, ["lang", "salt"]).select("lang", "terms", "sources", "own", "ids", "counts", F.col("every.source").alias("names"), F.col("every.n").alias("totals"), "v")
    schema = T._parse_datatype_string("lang string, source string, other string, term string, value bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lang, terms, sources, own, ids, found, names, totals, v in zip(*(c.to_pylist() for c in batch.columns)):
                place = {s: i for i, s in enumerate(names)}
                at = np.array([place[s] for s in sources], np.int64)[np.array(own, np.int64)] if own else np.zeros(0, np.int64)
                pairs, tops = compare(len(terms), at, np.array(ids, np.int64), np.array(found, np.int64), np.array(totals, np.int64), v)
                out = [(names[a], names[b], None, x) for a, b, x in pairs] + [(names[a], None, terms[t].decode(), x) for a, t, x in tops]
                cols = [[lang] * len(out), *(list(c) for c in zip(*out))] if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    C.small_batches(spark, 16)
    return met.mapInArrow(run, schema)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each group of a language is from its other groups, and by which terms.

    Null texts, languages and sources count as ''.  A language without kept terms has its groups' pairs
    with value 0 and no terms; one with a single group has no pairs; an empty table gives no rows.  Rows
    that repeat count each time.
    """
    every = C.checkpointed(counts(docs, lang, source, text))
    known = Window.partitionBy("lang", "term")
    kept = C.checkpointed(every.where("term is not null").withColumn("all", F.sum("docs").over(known)).where(F.col("all") >= MIN_DOCS))
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    group = every.where("term is null").select("lang", "source").join(total, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = group.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")).join(v, "lang", "left")
    found = C.checkpointed(parts(encode(kept), C.checkpointed(groups.select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v")))))
    pair = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pair = pair.unionByName(pair.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").select("*", rank)
    term = found.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").select("*", rank).where(F.col("rank") <= TOP)
    return pair.unionByName(term)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d),
c AS MATERIALIZED (SELECT r, lang, source, item, count(*) AS n FROM o GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, item, sum(n)::BIGINT AS n FROM c GROUP BY lang, item HAVING count(*) >= 30),
k AS MATERIALIZED (SELECT lang, source, item, sum(n)::BIGINT AS n FROM c SEMI JOIN kept USING (lang, item) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN k USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT tot.lang, tot.source, kept.item, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 5)) // (tot.total + 5 * v) AS p,
  1 + (1000000000::HUGEINT * (kept.n + 5)) // (v.total + 5 * v) AS q FROM tot JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN k ON k.lang = tot.lang AND k.source = tot.source AND k.item = kept.item),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
