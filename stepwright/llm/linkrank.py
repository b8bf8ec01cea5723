"""URL filter: rules first, then trust and distrust propagated over the host graph."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Production rules: verdict, host, path.  A rule fits its host and all subdomains below its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, ROUNDS, THRESHOLD = 0.5, 12, 0.25
_LINK = r"(?i)href\s*=\s*[\x22']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22'\s<>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def match_rules(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, block before allow on a tie; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """``src, dst, w``: links of pages to other hosts with their counts, and each host's parent domain, both ways."""
    host, _ = host_path(F.col("url"))
    p = C.pick(pages, "url", "html").select(host.alias("src"), "html").where("src <> ''")
    to = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))))
    links = p.select("src", to.alias("dst")).select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    links = C.checkpointed(links)  # pages are read for them once
    if not parents:
        return links
    known = p.select("src").union(links.select("dst")).distinct()
    labels = F.split("src", "\\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("b")))
    up = known.where("instr(src, '.') > 0").select(F.explode(chain).alias("e")).select("e.*").where("instr(b, '.') > 0").distinct()
    both = up.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(up.select("b", "a")).withColumn("w", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, trust, distrust)`` over ``edges(src, dst, w)``.

    Trust is personalised PageRank along the edges, distrust the same along the reversed edges: what
    links to a blocked host is suspect.  Mass is not normalised over seeds, so scores stay comparable
    whatever the number of hosts.  Both ranks move in one join and one aggregation a round.
    """
    one = edges.select(F.lit(0).alias("kind"), "src", "dst", "w").union(edges.select(F.lit(1), F.col("dst"), F.col("src"), "w"))
    out = one.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    step = C.checkpointed(one.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("all") * damping).alias("f")))
    start = seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), "host", F.col("trust").alias("r")), F.struct(F.lit(1).alias("kind"), "host", F.col("distrust").alias("r")))).alias("s")).select("s.*").where("r > 0")
    base = C.checkpointed(start.select("kind", "host", (F.col("r") * (1 - damping)).alias("r")))
    rank = base
    for i in range(rounds):
        moved = rank.join(step, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("r") * F.col("f")).alias("r"))
        rank = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % 4 == 3:
            rank = C.checkpointed(rank)
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)) / (1 - damping)
    return rank.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    The rule that fits decides; a page without one is blocked when its host's distrust exceeds its trust
    by ``threshold``.  Seeds are the shares of a host's pages that rules allow and block.  Null and
    malformed urls have an empty host, no rule and are allowed; null html has no links.  One row for
    each input row, repeated rows included.
    """
    host, path = host_path(F.col("url"))
    own = C.pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(rules, F.col("host"), F.col("path"))
    own = own.withColumn("rule", rule).withColumn("ruled", verdict)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = C.checkpointed(own.groupBy("host").agg(F.count("*").alias("pages"), share("allow").alias("trust"), share("block").alias("distrust")))
    ranks = propagate(hosts.where("host <> ''").drop("pages"), host_edges(pages), damping, rounds)
    table = C.checkpointed(hosts.select("host", "pages").join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"]))
    got = C.hot_join(own, table, ("host",), "pages", ("page_id", "path"))
    own_verdict = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return got.select("page_id", "host", "path", "rule", F.coalesce("ruled", own_verdict).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(C.table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def oracle() -> str:
    """The production query in DuckDB: the rounds of propagation are written out one after another."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "block"), reverse=True)
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"
    link = r"""(?i)href\s*=\s*[\x22'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22''\s<>]+)"""
    lower = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    turn = lambda i: f"r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(r) AS r FROM (SELECT * FROM base UNION ALL SELECT kind, dst, r * f FROM r{i} JOIN step USING (kind, host)) GROUP BY kind, host)"
    return f"""WITH p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
own AS (SELECT page_id, html, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM h),
l AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS d FROM own WHERE host <> ''),
links AS (SELECT src, translate(d, {lower}) AS dst, count(*) AS w FROM l WHERE src <> translate(d, {lower}) GROUP BY 1, 2),
known AS (SELECT host AS src FROM own WHERE host <> '' UNION SELECT dst FROM links),
parts AS (SELECT string_split(src, '.') AS x FROM known WHERE contains(src, '.')),
pairs AS (SELECT x, unnest(range(1, len(x))) AS i FROM parts),
up AS (SELECT DISTINCT array_to_string(x[i:], '.') AS a, array_to_string(x[i + 1:], '.') AS b FROM pairs WHERE len(x) - i >= 2),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM links UNION ALL SELECT a, b, 1 FROM up UNION ALL SELECT b, a, 1 FROM up) GROUP BY src, dst),
ways AS (SELECT 0 AS kind, src AS host, dst, w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges),
step AS MATERIALIZED (SELECT kind, host, dst, w / sum(w) OVER (PARTITION BY kind, host) * {DAMPING} AS f FROM ways),
share AS (SELECT host, avg((ruled IS NOT DISTINCT FROM 'allow')::INT) AS t, avg((ruled IS NOT DISTINCT FROM 'block')::INT) AS d FROM own WHERE host <> '' GROUP BY host),
base AS MATERIALIZED (SELECT 0 AS kind, host, t * {1 - DAMPING} AS r FROM share WHERE t > 0 UNION ALL SELECT 1, host, d * {1 - DAMPING} FROM share WHERE d > 0),
r0 AS (SELECT * FROM base), {", ".join(map(turn, range(ROUNDS)))},
s AS (SELECT host, coalesce(sum(r) FILTER (WHERE kind = 0), 0) / {1 - DAMPING} AS trust, coalesce(sum(r) FILTER (WHERE kind = 1), 0) / {1 - DAMPING} AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust FROM own LEFT JOIN s USING (host)"""
