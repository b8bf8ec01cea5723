"""Jaccard join of shingle sets with skipping by set relations, for near copies of whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

#: Words of a shingle; sets link when ``OF * intersection >= ALIKE * union``.
WIDTH, ALIKE, OF = 4, 85, 100
#: Shingles that one text in ``SAMPLE`` has twice stand last in the order, the most frequent at the end; so many at most.
SAMPLE, COMMON = 64, 1 << 17
#: Sets and shingles of one block of a list; a longer list is met block by block.
BLOCK_SETS, BLOCK_SHINGLES = 384, 1 << 19
#: So few sets are compared pair by pair.
FEW = 4
#: Sets of so few are paired where they share a shingle; pairs must share one more of their first shingles for each
#: ``PER`` shingles of the smaller set, for which so many more stand in the index.
LIGHT, PER = 32, 32


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of a text's different shingles, ascending; fewer words are one shingle as a whole, none are none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digest = xxhash.xxh3_64_digest
    parts = []
    for at in range(0, len(words) - width + 1, 1 << 16):
        own = words[at : at + (1 << 16) + width - 1]
        parts.append(np.unique(np.frombuffer(b"".join([digest(x) for x in map(b" ".join, zip(*(own[i:] for i in range(width))))]), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def least(n, m, alike: int = ALIKE):
    """The smallest intersection that links sets of ``n`` and ``m`` shingles."""
    return -(-alike * (n + m) // (OF + alike))


def prefix(n, alike: int = ALIKE):
    """How many of its first shingles a set needs in the index: linked sets share one of these."""
    return n - -(-alike * n // OF) + 1


def indexed(n, alike: int = ALIKE):
    """How many stand in the index, so that linked sets share ``1 + least(n, m) // PER`` of them."""
    return np.minimum(n, prefix(n, alike) + n // PER)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Order:
    """The order of shingles: frequent ones, as far as they are known, last; the others by hash."""

    def __init__(self, common: list[tuple[int, int]]):
        table = np.array(sorted((c & (1 << 64) - 1, n) for c, n in common), np.uint64).reshape(-1, 2)
        self.common, self.n = table[:, 0], table[:, 1]

    def __call__(self, found: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return found
        at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
        n = np.where(self.common[at] == found, self.n[at], 0)
        return found[np.argsort(n, kind="stable")]


def common_shingles(docs: DataFrame, text: str, width: int, sample: int = SAMPLE, most: int = COMMON) -> list[tuple[int, int]]:
    """The shingles found most often in one text in ``sample``, by hash of the text; at most ``most``.

    They only set the order of shingles, on which the work depends but not the result.
    """
    src = C.pick(docs, text).withColumn("raw", C.raw_hash(text)).where(F.pmod(F.xxhash64(F.lit(7), "raw"), F.lit(sample)) == 0).select("raw", F.col(text).cast("binary").alias("body"))
    C.small_batches(docs.sparkSession)
    schema = T._parse_datatype_string("s bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen: set = set()  # copies in one task count once
        for batch in batches:
            for raw, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if raw not in seen:
                    seen.add(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(shingles(body or b"", width)))], schema=arrow)

    n = src.mapInArrow(run, schema).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    return [tuple(r) for r in n.orderBy(F.desc("n"), "s").limit(most).collect()]


def _sets(docs: DataFrame, key: str, text: str, width: int, alike: int, order: Order, whole: bool) -> DataFrame:
    """``id, raw, n, a, b, s`` of every text: size and 128-bit hash of its set, and its first shingles in ``order``.

    Within a task only the first copy of a set has ``s``.  ``whole``: rows with ``s`` only, with all shingles.
    """
    C.small_batches(docs.sparkSession)
    src = C.pick(docs, key, text).select(F.col(key).alias("id"), C.raw_hash(text).alias("raw"), F.col(text).cast("binary").alias("body"))
    schema = T.StructType(src.schema.fields[:2] + T._parse_datatype_string("n bigint, a bigint, b bigint, s array<bigint>").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen: set = set()
        for batch in batches:
            at, n, ids, own = [], [], [], []
            for k, body in enumerate(batch.column(2).to_pylist()):
                found = shingles(body or b"", width)
                h = xxhash.xxh3_128_digest(found.tobytes())
                fresh = len(found) and h not in seen
                if fresh:
                    seen.add(h)
                elif whole:
                    continue
                at.append(k)
                n.append(len(found))
                ids.append(h)
                own.append(_signed(order(found)[: None if whole else int(indexed(len(found), alike))]) if fresh else None)
            take = pa.array(at, pa.int64())
            half = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(n, pa.int64()), pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(own, arrow.field("s").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return src.mapInArrow(run, schema)


class Group:
    """Sets that meet: an index of their first shingles, and one of all."""

    def __init__(self, sets: list[np.ndarray], alike: int):
        self.alike = alike
        self.n = np.array([len(s) for s in sets])
        self.sizes, self.rank = np.unique(self.n, return_inverse=True)
        flat = np.concatenate(sets)
        self.end = np.cumsum(self.n)
        owner = np.repeat(np.arange(len(sets)), self.n)
        kinds, self.flat = np.unique(flat, return_inverse=True)
        place = np.argsort(self.flat, kind="stable")
        self.members, self.start = owner[place], np.concatenate([[0], np.cumsum(np.bincount(self.flat, minlength=len(kinds)))])
        pos = np.arange(len(flat)) - np.repeat(self.end - self.n, self.n)
        first = np.flatnonzero(pos < prefix(self.n, alike)[owner])
        self.width = int(pos[first].max()) + 2
        keys = (self.flat[first] * len(self.sizes) + self.rank[owner[first]]) * self.width + pos[first]
        place = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[place], owner[first][place]
        self.inside = np.zeros(len(kinds), bool)
        self.base = None

    def own(self, x: int) -> np.ndarray:
        return self.flat[self.end[x] - self.n[x] : self.end[x]]

    def candidates(self, x: int) -> np.ndarray:
        """Sets that may link with ``x``, by skipping in the lists of its first shingles.

        A list is in blocks of one size, each by position.  Blocks of other sizes than may link are
        skipped, and so is the rest of a block from the position on where too few shingles are left.
        """
        n = int(self.n[x])
        lo, hi = np.searchsorted(self.sizes, -(-self.alike * n // OF)), np.searchsorted(self.sizes, n * OF // self.alike, "right")
        sizes = self.sizes[lo:hi]
        need = least(n, sizes, self.alike)
        mine = self.own(x)[: prefix(n, self.alike)]
        block = (mine[:, None] * len(self.sizes) + np.arange(lo, hi)) * self.width
        left = np.searchsorted(self.keys, block)
        right = np.searchsorted(self.keys, block + np.clip(sizes - need + 1, 0, self.width - 1))
        right = np.where(np.arange(len(mine))[:, None] <= n - need, right, left)
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(left[right > left].tolist(), right[right > left].tolist())] or [np.zeros(0, np.int64)]))

    def _count(self, kinds: np.ndarray) -> np.ndarray:
        a, b = self.start[kinds], self.start[kinds + 1]
        return np.bincount(np.concatenate([self.members[i:j] for i, j in zip(a.tolist(), b.tolist())] or [np.zeros(0, np.int64)]), minlength=len(self.n))

    def overlaps(self, x: int) -> np.ndarray:
        """Shingles that ``x`` shares with each set; taken from those of a set much like ``x`` by the shingles in which the two differ."""
        mine = self.own(x)
        if self.base is not None:
            more = mine[~self.inside[mine]]
            if 2 * (len(self.base) - (len(mine) - len(more)) + len(more)) < len(mine):
                here = np.zeros(len(self.inside), bool)
                here[mine] = True
                return self.shared + self._count(more) - self._count(self.base[~here[self.base]])
            self.inside[self.base] = False
        self.base, self.shared = mine, self._count(mine)
        self.inside[mine] = True
        return self.shared


def linked(sets: list[np.ndarray], alike: int = ALIKE, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets (in one order of shingles) that join all sets that links join; of two sides only links across.

    A set whose candidates are all joined with it already needs no overlaps.
    """
    n = [len(s) for s in sets]
    label, out = np.arange(len(sets)), []

    def join(x, y):
        if label[x] != label[y]:
            label[label == label[y]] = label[x]
            out.append((x, y))

    if len(sets) <= FEW:
        for x in range(len(sets)):
            for y in range(x):
                if label[x] != label[y] and (side is None or side[x] != side[y]) and alike * max(n[x], n[y]) <= OF * min(n[x], n[y]):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if OF * both >= alike * (n[x] + n[y] - both):
                        join(x, y)
        return out
    group = Group(sets, alike)
    for x in np.lexsort((np.array([s[0] for s in sets]), group.n)).tolist():
        near = group.candidates(x)
        near = near[label[near] != label[x]]
        if side is not None:
            near = near[side[near] != side[x]]
        if len(near):
            both = group.overlaps(x)[near]
            for y in near[OF * both >= alike * (n[x] + group.n[near] - both)].tolist():
                join(x, y)
    return out


def _tallied(light: DataFrame, alike: int) -> DataFrame:
    """``a, b``: sets of ``light(s, part, c, sid, n)`` that share enough first shingles for sets that link.

    In a list that was split by size a pair counts in the part of its larger class only.
    """
    one, two = (light.select("s", "part", F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    alive = (F.col("a") < F.col("b")) & (alike * F.greatest("na", "nb") <= OF * F.least("na", "nb")) & ((F.col("part") < 0) | (F.col("part") == F.greatest("ca", "cb")))
    met = one.join(two, ["s", "part"]).where(alive).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("na", "nb")).alias("n"))
    return met.where(F.col("shared") > F.floor(F.col("n") / PER)).select("a", "b")


def _meetings(first: DataFrame, sizes: DataFrame, alike: int, light: int, block_sets: int, block_shingles: int) -> DataFrame:
    """``lead, i, j, side, sid``: which sets meet, by ``first(sid, n, s)``, sets with their first shingles, and ``sizes(sid, n)``.

    The sets of a short list are paired, and pairs that share too few first shingles go; what hangs together by
    the others meets.  A longer list is split by size into overlapping parts first, as sets of far sizes
    never link.  Parts that are still long meet whole, under their smallest set, and parts with one smallest
    set are one.  What is too much for a task meets in blocks, two at a time.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(OF / (alike - 1)))).cast("int")  # linked sets are a class apart at most
    post = first.select("sid", "n", F.explode("s").alias("s"))
    lists = post.groupBy("s").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("sets")).where("low <> high").select("s", "sets")
    met = C.checkpointed(post.join(lists, "s").withColumn("c", size_class))
    short = met.where(F.col("sets") <= light).select("s", F.lit(-1).alias("part"), "c", "sid", "n")
    long = met.where(F.col("sets") > light).select("s", F.explode(F.array("c", F.col("c") + 1)).alias("part"), "c", "sid", "n")
    parts = C.checkpointed(long.groupBy("s", "part").agg(F.min("sid").alias("lead"), F.count("*").alias("sets")))
    long = C.hot_join(long, parts, ("s", "part"), "sets", ("sid",))
    edges = C.checkpointed(_tallied(short.unionByName(long.where(F.col("sets") <= light).select(*short.columns)), alike))
    near = C.components(edges).select(F.col("root").alias("lead"), F.col("node").alias("sid"))
    met = near.unionByName(long.where(F.col("sets") > light).select("lead", "sid")).distinct().join(sizes, "sid")
    met = C.checkpointed(met)
    need = F.greatest(F.lit(1), F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int")
    size = C.checkpointed(met.groupBy("lead").agg(F.count("*").alias("sets"), need.alias("blocks")).where("blocks > 1"))
    if size.isEmpty():
        return met.select("lead", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "sid")
    met = C.hot_join(met, size, ("lead",), "sets", ("sid",), "left")
    own = met.select("lead", "sid", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("side", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    each = own.select("lead", "sid", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    return each.select("lead", F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "sid")


def _links(met: DataFrame, alike: int) -> DataFrame:
    """``x, y``: links of ``met(lead, i, j, side, sid, s)`` that join all sets that links join."""
    spark = met.sparkSession
    schema = T._parse_datatype_string("x bigint, y bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        at, ids, sides, sets = None, [], [], []

        def close():
            pairs = linked(sets, alike, np.array(sides) if at[1] != at[2] else None) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], schema=arrow)

        for batch in batches:
            lead, i, j, side, sid = (batch.column(k).to_pylist() for k in range(5))
            ends, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, where in enumerate(zip(lead, i, j)):
                if where != at:
                    if at:
                        yield close()
                    at, ids, sides, sets = where, [], [], []
                if ids and ids[-1] == sid[k]:  # one set from several tasks
                    continue
                ids.append(sid[k])
                sides.append(side[k])
                sets.append(flat[ends[k] : ends[k + 1]].copy())
        if at:
            yield close()

    C.small_batches(spark, 512)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return met.repartition(tasks, "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "sid").mapInArrow(run, schema)


def _grouped(docs: DataFrame, key: str, text: str, width: int, alike: int, sample: int, common: int, light: int, block_sets: int, block_shingles: int) -> DataFrame:
    """``id, raw, n, component_id`` of every row; ``raw`` is a hash of its text."""
    order = Order(common_shingles(docs, text, width, sample, common))
    own = C.checkpointed(_sets(docs, key, text, width, alike, order, False))
    node = C.checkpointed(own.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.count("*").alias("copies")))
    for seed in range(42, 99):  # numbered anew if two sets ever share a number
        number = F.xxhash64(F.lit(seed), "a", "b")
        if node.groupBy(number.alias("sid")).agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            break
    met = C.checkpointed(_meetings(own.where("s is not null").select(number.alias("sid"), "n", "s"), node.select(number.alias("sid"), "n"), alike, light, block_sets, block_shingles))
    wanted = C.checkpointed(met.select("sid").distinct())
    whole = C.likely_members(_sets(docs, key, text, width, alike, order, True).select(number.alias("sid"), "s"), wanted, "sid")
    edges = C.checkpointed(_links(met.join(whole, "sid").select("lead", "i", "j", "side", "sid", "s"), alike))
    root = C.components(edges, "x", "y")
    named = node.select(number.alias("node"), "a", "b", "low", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = C.checkpointed(named.join(best, "root").select("a", "b", "component_id", "copies"))
    rows = own.select("id", "raw", "n", "a", "b")
    out = C.hot_join(rows.where("n > 0"), found, ("a", "b"), "copies", ("id", "raw")).select("id", "raw", "n", "component_id")
    return out.unionByName(rows.where("n = 0").select("id", "raw", "n", F.col("id").alias("component_id")))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, alike: int = ALIKE, sample: int = SAMPLE, common: int = COMMON, light: int = LIGHT, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``key, n_shingles, component_id``: the smallest key reachable over links, the row's own included.

    One row for each input row.  Equal sets are one before anything meets.  Texts without words and null
    texts have no shingles and link with nothing.  Rows with a null key take part; a component of null
    keys only has a null id.  An empty table gives an empty result.
    """
    out = _grouped(docs, key, text, width, alike, sample, common, light, block_sets, block_shingles)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, alike: int = ALIKE) -> DataFrame:
    """The documents, all columns, that have the smallest key of their group, one row for a row repeated.

    Texts without words stay, as do the different texts of a group of null keys only.
    """
    found = _grouped(docs, key, text, width, alike, SAMPLE, COMMON, LIGHT, BLOCK_SETS, BLOCK_SHINGLES)
    return C.without(docs, found.select(F.col("id").alias(key), "raw", F.col("id").eqNullSafe(F.col("component_id")).alias("stays")), key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS own FROM w),
t AS MATERIALIZED (SELECT r, len(own) AS n, unnest(own) AS x FROM s),
p AS (SELECT a.r AS x, b.r AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
e AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * shared >= 85 * (n - shared)),
reach(x, y) AS (SELECT r, r FROM s UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT any_value(a.doc_id) AS doc_id, any_value(len(a.own))::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN s a ON a.r = reach.x JOIN s b ON b.r = reach.y GROUP BY reach.x
"""
