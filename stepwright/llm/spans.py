"""Substring dedup on sliding runs of consecutive sentences, joined over the whole corpus."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

#: A run has at least this many sentences and this many words.
RUN_SENTENCES, RUN_WORDS = 3, 25
#: Sentences are cut after the word with the least hash (the last of equal ones) of every so many words in
#: a row.  Two texts that share 51 words share the cuts from the 9th word on to the 9th from the end at
#: least, so 34 words: whatever the first cut, a run of at most 25 + 8 words from it fits.
WINDOW = 9


class Pieces(list):
    """``(start, end, words)`` in bytes, and by ``kinds`` the piece counts at which each way of cutting ends a piece."""

    kinds: list[list[int]]


def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b" \t\n\x0b\x0c\r")] = True
    return out


def _least(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Words with the least hash of some window within a part."""
    m = np.minimum(key[:-1], key[1:])
    m = np.minimum(m[:-2], m[2:])
    m = np.minimum(m[:-4], m[4:])
    m = np.minimum(m[:-1], key[WINDOW - 1 :])
    return 0xFFFFFFFF - (m[part[: 1 - WINDOW] == part[WINDOW - 1 :]] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sentences(data: bytes) -> Pieces:
    """Texts cut in two ways, into pieces that end where either does.

    Both end sentences at ``.``, ``!``, ``?`` before white space and cut them by ``WINDOW``.  The first takes line
    ends for plain white space, so that a passage is found however it is wrapped; the second ends
    sentences there too, so that repeated lines are found whole whatever stands around them.
    """
    out = Pieces()
    out.kinds = [[]]
    words = data.split()
    n = len(words)
    if not n:
        return out
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = C.process_cache(("span spaces",), _spaces)[raw]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = turn[::2], turn[1::2]
    last = raw[ends - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    stop[-1] = True
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    broken = np.append(line[1:] != line[:-1], True)
    key = None
    if n >= WINDOW:
        key = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, n) << np.uint64(32)
        key |= np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    ways = []
    for end in (stop,) if not (broken & ~stop).any() else (stop, stop | broken):
        mark = end.copy()
        if key is not None:
            mark[_least(key, np.cumsum(end) - end)] = True
        ways.append(mark)
    cuts = np.flatnonzero(np.logical_or.reduce(ways))
    firsts = np.append(0, cuts[:-1] + 1)
    out.extend(zip(starts[firsts].tolist(), ends[cuts].tolist(), (cuts - firsts + 1).tolist()))
    out.kinds = [(np.flatnonzero(m[cuts]) + 1).tolist() for m in ways]
    return out


def runs(spans: list[tuple[int, int, int]], least: int = RUN_SENTENCES, words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Piece ranges ``(first, last)``: every run that holds no shorter one, for each way of cutting.

    A run has ``least`` sentences and ``words`` words at least.  From each sentence the shortest run on and
    the shortest run back are all of those.  A longer span that repeats is made of such runs, each of
    which repeats with it, so hashing longer ones too would remove nothing more.  A text without any
    run is one run as a whole.
    """
    total = [0, *accumulate(s[2] for s in spans)]
    found = {}
    for stops in getattr(spans, "kinds", None) or [range(1, len(spans) + 1)]:
        at = [0, *stops]
        for i, j in _runs([total[k] for k in at], least, words):
            found[at[i], at[j] - 1] = None
    return list(found) or [(0, len(spans) - 1)] * bool(spans)


def _runs(total: list[int], least: int, words: int):
    """``(i, j)`` of boundaries that enclose a run, by the words before each boundary."""
    n, j = len(total) - 1, 0
    for i in range(n):
        j = max(j, i + least)
        while j <= n and total[j] - total[i] < words:
            j += 1
        if j > n:
            break
        yield i, j
    i = n
    for e in range(n, 0, -1):
        i = min(i, e - least)
        while i >= 0 and total[e] - total[i] < words:
            i -= 1
        if i < 0:
            break
        yield i, e


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, row, body``: ``row`` is a hash of the text, so that rows that repeat a key stay apart unless they are equal."""
    return C.pick(docs, key, text).select(F.col(key).alias("id"), C.raw_hash(text).alias("row"), F.col(text).cast("binary").alias("body"))


def run_table(own: DataFrame) -> DataFrame:
    """``id, row, at, a, b``: every run of every text of ``_own`` rows and 128 bits of hash of its words.

    ``at`` holds the run's first and last piece, and in its lowest bit whether the run stands earlier in the same text.
    """
    C.small_batches(own.sparkSession, 128)
    schema = T.StructType(own.schema.fields[:2] + T._parse_datatype_string("at bigint, a bigint, b bigint").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows, at, ids = [], [], []
            for k, body in enumerate(batch.column(2).to_pylist()):
                if not body:
                    continue
                spans = sentences(body)
                # the words of piece i stand at place[i] of the plain text, one space between words
                plain, place, seen = b" ".join(body.split()), [0], set()
                for a, b, _ in spans:
                    place.append(place[-1] + len(b" ".join(body[a:b].split())) + 1)
                for i, j in sorted(runs(spans)):
                    h = xxhash.xxh3_128_digest(plain[place[i] : place[j + 1] - 1])
                    rows.append(k)
                    ids.append(h)
                    at.append(i << 32 | j << 1 | (h in seen))
                    seen.add(h)
            take = pa.array(rows, pa.int32())
            hashes = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return own.mapInArrow(run, schema)


def _hot(own: DataFrame, sample: int, hot_rows: int) -> DataFrame:
    """``a, b, copies`` of runs that stand very often, judged by one text in ``sample``; at most ``HOT_KEYS``."""
    some = run_table(own.where(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0))
    n = C.checkpointed(some.groupBy("a", "b").agg((F.count("*") * sample).alias("n")).where(F.col("n") > hot_rows))
    limit = max(hot_rows, -(-(n.agg(F.sum("n")).first()[0] or 0) // C.HOT_KEYS))
    return n.where(F.col("n") > limit).select("a", "b", F.ceil(F.col("n") / limit).cast("int").alias("copies"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 64, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """``id, row, ranges array<struct<first,last>>``: the non-first repeated runs of each row.

    A run's first occurrence is its first in the row with the smallest key, null keys last; of rows that
    share a key, in the one with the smallest hash of its text.  Runs move once, as hashes, and are
    compared where they meet.  A very common run meets in several tasks: whatever is not first in its
    task is not first at all, and the few that are first in theirs meet once more.  Which runs are
    split that way is judged by a sample of the texts; it changes the plan, never the result.
    """
    own = _own(docs, key, text)
    salt = F.pmod(F.xxhash64("id", "row"), F.col("copies")).cast("int")
    table = run_table(own).join(F.broadcast(_hot(own, sample, hot_rows)), ["a", "b"], "left").withColumn("salt", F.coalesce(salt, F.lit(-1))).drop("copies")
    order = F.struct(F.col("id").isNull().alias("z"), "id", "row")
    meet = Window.partitionBy("a", "b", "salt")
    met = table.withColumn("n", F.count("*").over(meet)).withColumn("low", F.min(order).over(meet))
    again = F.expr("at & 1") == 1
    first = order.eqNullSafe(F.col("low")) & ~again
    met = C.checkpointed(met.where((F.col("n") > 1) | (F.col("salt") >= 0)).withColumn("open", first & (F.col("salt") >= 0)).where(~first | F.col("open")).drop("n", "low"))
    late = met.where("open").withColumn("low", F.min(order).over(Window.partitionBy("a", "b"))).where(~order.eqNullSafe(F.col("low"))).drop("low")
    hit = met.where(~F.col("open")).unionByName(late)
    place = F.struct(F.expr("int(shiftright(at, 32))").alias("first"), F.expr("int(shiftright(at & 4294967295L, 1))").alias("last"))
    return hit.groupBy("id", "row").agg(F.collect_set(place).alias("ranges"))


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", places: bool = True, sample: int = 64, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """``key, n_sentences, n_removed, removed_words, text, removed``: texts without repeated runs.

    Every sentence inside a non-first repeated run goes, with the white space after it.  ``removed`` has
    the character spans (null without ``places``).  Of rows equal in key and text one counts as first and
    the others lose every sentence.  Null texts stay null with no sentence; texts without a repeated
    run stay as they are.
    """
    own = _own(docs, key, text)
    copies = C.checkpointed(own.groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1"))
    own = own.withColumn("more", F.lit(0).cast("bigint"))
    if not copies.isEmpty():
        names = copies.select(F.col("id").alias("ci"), F.col("row").alias("cr"), (F.col("n") - 1).alias("c"))
        same = F.col("id").eqNullSafe(F.col("ci")) & (F.col("row") == F.col("cr"))
        once = own.drop("more").join(names, same).dropDuplicates(["id", "row"]).select("id", "row", "body", F.explode(F.array(F.lit(0).cast("bigint"), "c")).alias("more"))
        own = own.join(names, same, "left_anti").unionByName(once)
    found = repeated(docs, key, text, sample, hot_rows).withColumnsRenamed({"id": "ri", "row": "rr"})
    got = own.join(found, F.col("id").eqNullSafe(F.col("ri")) & (F.col("row") == F.col("rr")), "left").select(F.col("id").alias(key), "body", "ranges", "more")
    C.small_batches(docs.sparkSession, 128)
    fields = "n_sentences bigint, n_removed bigint, removed_words bigint, text string, removed array<struct<start:int,end:int>>, more bigint"
    schema = T.StructType([got.schema[key]] + T._parse_datatype_string(fields).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for body, ranges, more in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                spans = sentences(body or b"")
                bad = range(len(spans)) if more else sorted({i for r in ranges or [] for i in range(r["first"], r["last"] + 1)})
                keep, at, marks = [], 0, []
                for i in bad:
                    a, b = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(body)
                    keep.append(body[at:a])
                    at = b
                    if marks and marks[-1][1] == a:
                        marks[-1][1] = b
                    else:
                        marks.append([a, b])
                rest = None if body is None else b"".join([*keep, body[at:]]).decode("utf-8", "replace")
                chars = []
                if places:
                    flat, n, back = [x for m in marks for x in m], 0, 0
                    for x in flat:  # code points before each byte place, in one pass
                        n += len(body[back:x].decode("utf-8", "replace"))
                        chars.append(n)
                        back = x
                where = [{"start": a, "end": b} for a, b in zip(chars[::2], chars[1::2])] if places else None
                for c, v in zip(out, (len(spans), len(bad), sum(spans[i][2] for i in bad), rest, where)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(arrow)[1:6])), batch.column(3)], schema=arrow)

    made = got.mapInArrow(run, schema)
    return made.withColumn("more", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("more", F.lit(1))))).drop("more") if not copies.isEmpty() else made.drop("more")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(C.table(spark, sf_dir, "documents"), places=False)
    return found.select("doc_id", "n_sentences", "n_removed", "removed_words", (F.col("n_removed") > 0).alias("repeats"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
