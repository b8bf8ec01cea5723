"""Exact dedup with an extendible-hash index on shared files; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Keys a bucket may hold before it splits.
BUCKET_KEYS = 16_384
#: Directories up to this many slots go to the executors with a broadcast; larger ones are joined.
BROADCAST_SLOTS = 1 << 20
#: Levels counted below the depth that evenly spread keys need; more are counted only where these don't do.
SPARE_LEVELS = 4


def normalised(text: str = "text") -> Column:
    """Null is empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), C.SPACE, " ")


def _slot(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """``(slot, bucket, depth)`` for each slot of the directory of distinct hashes ``keys(h)``, and its depth.

    A bucket is the shortest prefix of hashes under which at most ``bucket_keys`` keys stand, so every
    overfull bucket has split, and the directory has doubled until its deepest bucket fits.  ``bucket``
    is the bucket's first slot.  Loads are counted by prefix on all levels at once: a row for each
    prefix, some ``2 ** SPARE_LEVELS`` rows for each bucket.  Only the depth reaches the driver.
    """
    spark = keys.sparkSession
    n = keys.count()
    levels = min(64, max(0, math.ceil(math.log2(max(n, 1) / bucket_keys))) + SPARE_LEVELS)
    while True:
        slots = keys.groupBy(_slot(F.col("h"), levels).alias("s")).agg(F.count("*").alias("n"))
        each = slots.select("s", "n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("d"))
        loads = each.groupBy("d", F.expr(f"shiftrightunsigned(s, {levels} - d)").alias("prefix")).agg(F.sum("n").alias("n"))
        over = C.checkpointed(loads.where(F.col("n") > bucket_keys).select("d", "prefix"))
        deepest = over.agg(F.max("d")).first()[0]
        depth = 0 if deepest is None else deepest + 1
        if depth <= levels or levels == 64:
            break
        levels = min(64, levels + 2 * SPARE_LEVELS)  # keys crowd under one prefix
    split = F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))).alias("d")
    every = spark.range(1 << depth).select(F.col("id").alias("slot"), split).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - d)"))
    own = every.join(over, ["d", "prefix"]).groupBy("slot").agg((F.max("d") + 1).alias("depth"))
    table = spark.range(1 << depth).select(F.col("id").alias("slot")).join(own, "slot", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return table.select("slot", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)").alias("bucket"), "depth"), depth


class Index:
    """An extendible-hash index in shared files below ``path``.

    ``directory`` has ``slot, bucket, depth``; ``buckets`` has ``bucket, h, chain, n_chain, body, keep_id,
    group_size, sha``, in order of bucket and hash, ``body`` only where texts share a hash.
    """

    def __init__(self, spark: SparkSession, path: str, depth: int):
        self.spark, self.path, self.depth = spark, path, depth

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/buckets")

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket of their ``h``, looked up in the directory's files."""
        table = self.spark.read.parquet(f"{self.path}/directory").select("slot", "bucket")
        table = F.broadcast(table) if 1 << self.depth <= BROADCAST_SLOTS else table
        return rows.withColumn("slot", _slot(F.col("h"), self.depth)).join(table, "slot").drop("slot")

    def probe(self, rows: DataFrame, texts: DataFrame, hot_rows: int = C.HOT_ROWS) -> DataFrame:
        """``id, raw, keep_id, group_size, sha`` of ``rows(id, raw, h)``, each looked up in its bucket.

        A chain of one text answers by bucket and hash, as its owner has compared the bytes of all that
        came there.  Rows whose hash several texts share bring theirs, from ``texts(id, raw, h, body)``,
        to be compared with the bytes in the chain.  A very frequent text is answered by several tasks.
        """
        known = self.entries()
        alone, chained = known.where("n_chain = 1").drop("chain", "n_chain", "body"), known.where("n_chain > 1").drop("chain", "n_chain")
        out = C.hot_join(self.with_bucket(rows), alone, ("bucket", "h"), "group_size", ("id", "raw"), hot_rows=hot_rows)
        out = out.select("id", "raw", "keep_id", "group_size", "sha")
        if chained.isEmpty():  # as good as always with 64 bits
            return out
        own = self.with_bucket(texts.join(chained.select("h").distinct(), "h", "left_semi"))
        return out.unionByName(own.join(chained, ["bucket", "h", "body"]).select(*out.columns))


def build_index(texts: DataFrame, rows: DataFrame, path: str, bucket_keys: int = BUCKET_KEYS) -> Index:
    """Write the index of ``texts(id, h, body)``, whose hashes ``rows(h)`` lists, to files below ``path``.

    The directory comes from the hashes alone.  Texts go to the task that owns their hash, copies combined
    before; the owner chains the different texts of a hash, compared by their bytes.  As a rule that is
    one text, and the chain's bytes can go.  Longer chains keep theirs, and their members are counted
    text by text.  Owners of ranges of buckets then write them.
    """
    spark = texts.sparkSession
    table, depth = directory(rows.select("h").distinct(), bucket_keys)
    C.write(table, f"{path}/directory")
    index = Index(spark, path, depth)
    met = texts.groupBy("h").agg(F.collect_set("body").alias("chain"), F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    several = F.size("chain") > 1
    met = met.select("h", "keep_id", "group_size", F.size("chain").alias("n_chain"), F.when(several, F.col("chain")).alias("texts"), F.when(~several, F.sha2(F.col("chain")[0], 256)).alias("sha"))
    met = C.write(met, f"{path}/met")
    done = met.where("n_chain = 1").select("h", F.lit(0).alias("chain"), "n_chain", F.lit(None).cast("string").alias("body"), "keep_id", "group_size", "sha")
    chains = met.where("n_chain > 1").select("h", "n_chain", F.posexplode(F.sort_array("texts")).alias("chain", "body"))
    if not chains.isEmpty():
        each = texts.join(chains, ["h", "body"]).groupBy("h", "chain", "n_chain", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        done = done.unionByName(each.withColumn("sha", F.sha2("body", 256)))
    owned = index.with_bucket(done).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain")
    C.write(owned, f"{path}/buckets")
    C.forget(spark, f"{path}/met")
    return index


def _judged(docs: DataFrame, key: str, text: str, hash_bits: int, bucket_keys: int) -> DataFrame:
    """``id, raw, keep_id, group_size, sha``: every row with the group it fell into."""
    spark = docs.sparkSession
    body = F.col("body")
    h = F.xxhash64(body) if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 64 - hash_bits), 64 - hash_bits)
    src = C.pick(docs, key, text)
    texts = src.select(F.col(key).alias("id"), C.raw_hash(text).alias("raw"), normalised(text).alias("body")).withColumn("h", h)
    rows = C.written(texts.select("id", "raw", "h"), "hashes")
    index = build_index(texts, rows, C.shared_path(spark, "extendible"), bucket_keys)
    return index.probe(rows, texts)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hash_bits: int = 64, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too.

    Null texts are empty texts.  The smallest key of equal texts stays; null keys come last, and a
    group of null keys has a null ``keep_id`` and keeps its rows.  Repeated rows with the smallest key
    are all kept here, as they are one document to any caller that goes by key.  ``hash_bits`` below 64
    only serves tests of chained collisions.  An empty table gives an empty result.
    """
    out = _judged(docs, key, text, hash_bits, bucket_keys)
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The documents, all columns, that stay: one row of each group.

    A group of null keys only keeps one row for each spelling of its white space.
    """
    found = _judged(docs, key, text, 64, bucket_keys)
    return C.without(docs, found.select(F.col("id").alias(key), "raw", F.col("id").eqNullSafe(F.col("keep_id")).alias("stays")), key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
