"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwright.operators.order import numbered

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Words a block aims at; blocks of one source, all blocks and output shards are bounded whatever the input.
BLOCK_WORDS, MAX_BLOCKS, ALL_BLOCKS, SHARD_WORDS, MAX_SHARDS = 20_000, 4096, 10**8, 500_000, 16_384
#: Sources are dealt to so many groups at most; only a total of each group is known everywhere.
GROUPS = 1024
#: Tables of sources and of draws go to the executors with a broadcast up to this many rows, else by a join.
BROADCAST_ROWS = 200_000


def level(words: float, weight: float, sums) -> tuple[float, float]:
    """Words left and weight free once no free source's share is above its limit.

    ``sums(left, free)`` gives the limits of the sources above theirs at that level, the weight of the others,
    and the number of those above.  The level only rises, so a source stays above; rounds end when none joins.
    """
    left, free, above = words, weight, 0
    while free:
        limits, others, n = sums(left, free)
        if n <= above:
            break
        left, free, above = words - limits, others, n
    return left, free


def targets(sizes: dict, weights=WEIGHTS, cap: float = MAX_EPOCHS) -> dict:
    """Words each source should give: by weight, none above ``cap`` times its size, excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}

    def sums(left, free):
        over = [s for s in order if left * w[s] / free > cap * sizes[s]]
        return float(sum(cap * sizes[s] for s in over)), float(sum(w[s] for s in order if s not in over)), len(over)

    left, free = level(float(sum(sizes.values())), float(sum(w.values())), sums)
    return {s: min(left * w[s] / free, float(cap * sizes[s])) if free else float(cap * sizes[s]) for s in order}


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """``targets`` of a table ``source, source_size, rank``: adds ``target``; sums, never sources, reach the driver."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size"), F.sum(w)).first()

    def sums(left, free):
        over = F.lit(left) * w / F.lit(free) > limit
        got = sources.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, w)), F.count_if(over)).first()
        return got[0] or 0.0, got[1] or 0.0, got[2]

    left, free = level(float(total[0] or 0), total[1] or 0.0, sums)
    return sources.withColumn("target", F.least(F.lit(left) * w / F.lit(free), limit) if free else limit)


def split_quotas(quotas: np.ndarray, shards: int, seed: int, totals: np.ndarray | None = None, g: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """``(shard, blocks of each source)`` in ascending shards, for the sources of group ``g``: halves of the
    shard range draw from the exact counts.

    The left half of a node takes its share of all blocks as one multivariate-hypergeometric draw over the
    groups' ``totals``, and a group's take is drawn over its own sources, which together is one such draw
    over all sources; what is left goes right.  Generators are seeded by node and group, so each
    group's task finds the same draws over groups, and reruns agree.
    """
    totals = np.array([quotas.sum()]) if totals is None else totals
    todo = [(0, shards, totals.astype(np.int64), quotas.astype(np.int64))]
    while todo:
        lo, hi, have, mine = todo.pop()
        if not have[g]:
            continue
        if hi - lo == 1:
            yield lo, mine
            continue
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals")
        own = np.random.default_rng([seed, lo, hi, g]).multivariate_hypergeometric(mine, int(left[g]), method="marginals")
        todo += [(mid, hi, have - left, mine - own), (lo, mid, left, own)]


def permuted(rank: int, n: int, size: int, target: float, words: np.ndarray, seed: int) -> list:
    """``(block, epoch, rest)`` of one source in the order of drawing: whole epochs, then blocks of a permutation up to
    the one that passes the target; only that one has ``rest``, the words still wanted of it."""
    if not size:
        return []
    full = min(MAX_EPOCHS, int(target // size))
    perms = [np.random.default_rng([seed, rank, epoch]).permutation(n) for epoch in range(min(full + 1, MAX_EPOCHS))]
    out = [(int(b), epoch, None) for epoch in range(full) for b in perms[epoch]]
    if full < MAX_EPOCHS:
        rest, sums = target - full * size, np.cumsum(words[perms[full]])
        k = int(np.searchsorted(sums, rest, "right"))
        out += [(int(b), full, None) for b in perms[full][:k]]
        if k < n:
            out.append((int(perms[full][k]), full, float(rest - (sums[k - 1] if k else 0))))
    return out


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def _block(key: str, seed: int, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), n).cast("int")


class Plan:
    """What a mix takes: ``draws`` tells for each row the shards and epochs of its copies.

    Sources, blocks and draws are tables.  The driver knows sums, the number of sources, and the
    blocks of each of at most ``GROUPS`` groups of sources.
    """

    def __init__(self, docs: DataFrame, key="doc_id", text="text", source="source", weights=WEIGHTS, seed=0, block_words=BLOCK_WORDS, max_blocks=MAX_BLOCKS, shard_words=SHARD_WORDS, groups=GROUPS, broadcast_rows=BROADCAST_ROWS):
        self.spark, self.key, self.seed, self.broadcast_rows = docs.sparkSession, key, seed, broadcast_rows
        size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(C.WORD)).cast("bigint")
        stats = C.pick(docs, key, text, source).select(F.col(key), F.col(source).alias("source"), size.alias("size"))
        self.stats = C.checkpointed(stats)  # ids and sizes only
        by = self.stats.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        by = numbered(by, [F.col("source").asc_nulls_last()], "rank")
        self.n_sources, total = by.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        self.shards = max(1, min(MAX_SHARDS, math.ceil(total / shard_words)))
        self.groups = max(1, min(groups, self.n_sources))
        n = F.least(F.lit(max_blocks), F.ceil(F.col("source_size") / max(block_words, total // ALL_BLOCKS)))
        more = {"n_blocks": F.greatest(F.lit(1), n).cast("int"), "grp": (F.col("rank") % self.groups).cast("int"), "_source": self._named()}
        self.sources = C.checkpointed(source_targets(by, weights).withColumns(more).drop("source"))
        self._plan()

    @staticmethod
    def _named() -> Column:
        """The source as a join key that is never null."""
        return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))

    def _met(self, rows: DataFrame, table: DataFrame, on: list, small: bool, how: str) -> DataFrame:
        """``rows`` with ``table``'s one row a key; a hot key of a table too large to broadcast is dealt to many tasks."""
        return rows.join(F.broadcast(table), on, how) if small else C.hot_join(rows, table, on, "n_rows", [self.key], how)

    def with_block(self, rows: DataFrame) -> DataFrame:
        own = rows.withColumn("_source", self._named())
        joined = self._met(own, self.sources.drop("grp"), ["_source"], self.n_sources <= self.broadcast_rows, "inner").drop("_source", "n_rows")
        return joined.withColumn("block", _block(self.key, self.seed, F.col("n_blocks"))).drop("n_blocks")

    def _plan(self) -> None:
        seed, shards = self.seed, self.shards
        words = self.with_block(self.stats).groupBy("rank", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n_rows"))
        words = C.checkpointed(words)
        mine = self.sources.select("grp", "rank", "n_blocks", "source_size", "target")

        def listed(one: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for rank, own in one.groupby("rank"):
                first, have = own.iloc[0], np.zeros(int(own["n_blocks"].iloc[0]), np.int64)
                have[own["block"].to_numpy()] = own["words"].to_numpy()
                order = permuted(int(rank), len(have), int(first["source_size"]), float(first["target"]), have, seed)
                rows += [(int(first["grp"]), int(rank), i, *x) for i, x in enumerate(order)]
            return pd.DataFrame(rows, columns=["grp", "rank", "place", "block", "epoch", "rest"])

        entries = words.join(mine, "rank").groupBy("grp").applyInPandas(listed, "grp int, rank long, place int, block int, epoch int, rest double")
        entries = C.checkpointed(entries)
        totals = np.zeros(self.groups, np.int64)
        for g, n in entries.groupBy("grp").count().collect():  # a row a group, GROUPS at most
            totals[g] = n

        def dealt(one: pd.DataFrame) -> pd.DataFrame:
            one = one.sort_values(["rank", "place"], ignore_index=True)
            ranks, starts, quotas = np.unique(one["rank"].to_numpy(), return_index=True, return_counts=True)
            at, shard = starts.copy(), np.zeros(len(one), np.int32)
            for s, blocks in split_quotas(quotas, shards, seed, totals, int(one["grp"].iloc[0])):
                for i in np.flatnonzero(blocks):
                    shard[at[i] : at[i] + blocks[i]] = s
                    at[i] += blocks[i]
            return one.assign(shard=shard)

        rows = entries.groupBy("grp").applyInPandas(dealt, "grp int, rank long, place int, block int, epoch int, rest double, shard int")
        rows = rows.drop("grp", "place").join(self._limits(entries), ["rank"], "left")
        until = F.when(F.col("rest").isNotNull(), F.coalesce(F.col("until"), F.lit(-(1 << 63))))
        draws = rows.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", until.alias("until")))).alias("d"))  # an entry an epoch
        self.table = C.checkpointed(draws.join(words.drop("words"), ["rank", "block"]))
        self.n_draws = self.table.count()

    def _limits(self, entries: DataFrame) -> DataFrame:
        """In each source's cut block, documents in hash order up to the one nearest to the words left."""
        cut = entries.where("rest is not null").select("rank", "block", "rest")
        cut = F.broadcast(cut) if self.n_sources <= self.broadcast_rows else cut  # a row a source at most
        own = self.with_block(self.stats).join(cut, ["rank", "block"]).withColumn("x", _hash(self.key, self.seed))
        each = own.groupBy("rank", "x").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        run = F.sum("size").over(W.partitionBy("rank").orderBy("x"))
        got = each.withColumn("run", run).where(F.col("run") - F.col("size") / 2 <= F.col("rest"))
        return got.groupBy("rank").agg(F.max("x").alias("until"))

    def draws(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with key and ``source``) and ``draws array<struct<epoch, shard, until>>``; up to ``broadcast_rows`` sources and draws no shuffle of texts."""
        out = self._met(self.with_block(docs), self.table, ["rank", "block"], self.n_draws <= self.broadcast_rows, "left")
        none = F.array().cast("array<struct<epoch:int,shard:int,until:bigint>>")
        mine = F.filter(F.coalesce(F.col("d"), none), lambda d: d["until"].isNull() | (_hash(self.key, self.seed) <= d["until"]))
        return out.withColumn("draws", mine).drop("d", "block", "rank", "n_rows")


def allocation(docs: DataFrame, key="doc_id", text="text", source="source", **how) -> DataFrame:
    """``key, size, source_size, target, taken, shards``: a row for each input row.

    ``shards`` lists the output shard of each copy, as the splitting tree deals the blocks; ``mix`` puts it there.

    Null texts have size zero and are taken zero words; a null source is a source of its own, last in
    order.  Rows that repeat a key are drawn together.  An empty table gives an empty result.
    """
    plan = Plan(docs, key, text, source, **how)
    d = plan.draws(plan.stats)
    return d.select(key, "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("bigint").alias("taken"), F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",").alias("shards"))


def mix(docs: DataFrame, key="doc_id", text="text", source="source", **how) -> DataFrame:
    """The mixed documents, all columns of ``docs``: rows repeat by epoch, dealt to shards, shuffled in each."""
    plan = Plan(docs, key, text, source, **how)
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = [names.index(c) for c in (key, source)]
    own = plain.withColumn(key, F.col(f"_c{at[0]}")).withColumn("source", F.col(f"_c{at[1]}"))
    rows = plan.draws(own).withColumn("draw", F.explode("draws"))
    order = F.xxhash64(F.lit(plan.seed + 2), F.col(key), F.col("draw.shard"), F.col("draw.epoch"))
    dealt = rows.withColumn("_shard", F.col("draw.shard")).repartitionById(plan.shards, "_shard").sortWithinPartitions(order)  # a task a shard
    return dealt.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation(C.table(spark, sf_dir, "documents"))
