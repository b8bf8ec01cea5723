"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Two fingerprints at most two bits apart differ in at most two of eight positional bytes.
MAX_BITS = 2
MIN_SHARED = 8 - MAX_BITS
#: Posting lists are keyed by so many positional bytes.  Single ones have only 2,048 keys, whose lists grow
#: with the corpus and whose pairs grow with its square.
KEY_BYTES = 5
#: A pair that shares m positional bytes meets in comb(m, KEY_BYTES) lists; this many are guaranteed.
MIN_TALLY = comb(MIN_SHARED, KEY_BYTES)
#: Longer posting lists are not paired but joined through their fingerprints' one-bit neighbourhoods.
LIST_MAX = 1024


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash (unsigned) of a text: XXH64 of word shingles, repeats counted, strict majority."""
    words = data.lower().split()
    if not words:
        return 0
    digest, n, count = xxhash.xxh64_digest, max(1, len(words) - width + 1), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # the words of the text are held, its hashes in part
        own = words[at : at + (1 << 15) + width - 1]
        shingles = map(b" ".join, zip(*(own[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        raw = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, 8)
        lanes = np.unpackbits(raw, axis=1).view(np.uint64)
        for k in range(0, len(lanes), 255):  # eight one-byte counters in each 64-bit sum
            count += lanes[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep=("doc_id",), width: int = 3, text: str = "text") -> DataFrame:
    """``keep`` and ``fp bigint`` (the 64 bits as a signed number) of every whole text.

    Null texts and texts without words have fingerprint zero; shorter texts hash their whole sequence.
    """

    def fn(texts: list[bytes]) -> list:
        out = np.array([fingerprint(t, width) for t in texts], np.uint64)
        return [out.view(np.int64)]

    return C.map_texts(docs, keep, [("fp", "bigint")], fn, text)


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def postings(fps: DataFrame) -> DataFrame:
    """``k, v, fp``: each distinct fingerprint under every choice ``k`` of ``KEY_BYTES`` positions, by its bytes ``v`` there."""
    keys = [F.struct(F.lit(i).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("v")) for i, c in enumerate(combinations(range(8), KEY_BYTES))]
    nodes = fps.select("fp").distinct()
    spark = fps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() >> 16)
    # by another hash than the distinct's, which Spark would take for the same partitioning and merge into few tasks
    return nodes.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(F.array(*keys)).alias("p")).select("p.k", "p.v", "fp")


def tallied(lists: DataFrame) -> DataFrame:
    """``a, b, tally``: pairs of fingerprints that meet, and in how many posting lists."""
    other = lists.select("k", "v", F.col("fp").alias("b"))
    pairs = lists.select("k", "v", F.col("fp").alias("a")).join(other, ["k", "v"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("tally"))


def links(fps: DataFrame, list_max: int = LIST_MAX) -> DataFrame:
    """Edges ``(a, b)`` among distinct fingerprints whose closure has every pair within MAX_BITS.

    The inverted index has posting lists by positional bytes; a pair's shared bytes are tallied over the
    lists in which it meets.  Pairs that reach the guaranteed tally are verified by bit count.  Lists
    above ``list_max`` never pair their members: each member goes to its 65 one-bit neighbours and
    links to the smallest fingerprint there; members of one neighbour are within two bits of each
    other, and any two within two bits have a common one, so this loses no link.
    """
    post = postings(fps)
    sizes = post.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    sized = C.checkpointed(post.join(sizes, ["k", "v"]))
    met = tallied(sized.where(F.col("n") <= list_max))
    near = met.where((F.col("tally") >= MIN_TALLY) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    heavy = sized.where(F.col("n") > list_max).select("fp").distinct()
    flips = [F.lit(0)] + [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)]
    around = heavy.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f.cast("bigint")) for f in flips])).alias("at"))
    centre = around.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = around.join(centre, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(star).distinct()


def _grouped(docs: DataFrame, width: int, text: str, key: str, list_max: int) -> DataFrame:
    own = C.pick(docs, key, text).withColumn("raw", C.raw_hash(text))
    fps = C.checkpointed(fingerprints(own.select(F.col(key).alias("id"), "raw", F.col(text).alias("body")), ("id", "raw"), width, "body"))
    node = C.checkpointed(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    comp = C.components(links(node, list_max))
    roots = node.join(comp, node.fp == comp.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    best = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = C.checkpointed(roots.join(best, "root").select("fp", "component_id", "n"))
    return C.hot_join(fps, named, ("fp",), "n", ("id", "raw")).drop("n")


def near_duplicates(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id", list_max: int = LIST_MAX) -> DataFrame:
    """``key, fp, component_id``: the smallest key reachable over links, the row's own included.

    One row for each input row.  Equal fingerprints are linked, fingerprint zero too.  Rows with a null
    key take part; a component of null keys only has a null id.  Documents are reduced to distinct
    fingerprints before any pairing, so copies cost nothing.
    """
    return _grouped(docs, width, text, key, list_max).select(F.col("id").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, all columns, that have the smallest key of their group, one row for a row repeated.

    A group of null keys only keeps its different texts.
    """
    found = _grouped(docs, width, text, key, LIST_MAX)
    return C.without(docs, found.select(F.col("id").alias(key), "raw", F.col("id").eqNullSafe(F.col("component_id")).alias("stays")), key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
