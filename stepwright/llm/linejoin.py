"""Line dedup by a segment-partition edit join over the distinct lines of a corpus."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

#: Lines are one that are at most so many edits (code points) apart, and alike for four fifths of the longer one.
EDITS, ALIKE = 2, 5
#: The least code points of a line that may have such a partner: it is one longer, at one edit.
MIN_CHARS = ALIKE - 1
#: Lines side by side in one batch, at most so many code points unless one line has more.
CHUNK_LINES, CHUNK_CHARS = 4096, 1 << 20
#: Lines of a key of more are linked to representatives first; so many keys at most are broadcast, more are joined.
CROWD, BROADCAST_KEYS = 128, 1 << 18
#: Representatives of a crowded key, by as many hashes; each of its bands has one more.
REPS = 4
#: Index rows of a crowded key and band that a row meets in one task; more are met in several.
BLOCK = 1024
#: Texts of candidates go to all executors up to so many bytes; more are joined by shuffles.
TEXT_BYTES = 16 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_SALT = 71


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: bit-parallel rows of a diagonal band of 2k + 1 cells."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    lo, top = 0, len(a)
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if m == 0:
        return n <= k
    # Bit i of a row's words is the vertical step into pattern place (row - k + i); places before the
    # pattern count up from the band's edge, so the diagonal through bit k carries the distance.
    width, full = 2 * k + 1, (1 << 2 * k + 1) - 1
    peq: dict[str, tuple[int, int]] = {}  # by character: its places in the band, and the row they are counted from
    for i in range(min(k, m)):
        own, _ = peq.get(a[i], (0, 0))
        peq[a[i]] = own | 1 << i + k, 0
    vp, vn, dist = full >> k << k, 0, min(k, m)
    for j, c in enumerate(b):
        if j + k < m:
            own, at = peq.get(a[j + k], (0, j))
            peq[a[j + k]] = own >> j - at | 1 << 2 * k, j
        own, at = peq.get(c, (0, j))
        eq = own >> j - at & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + k < m:  # the band's lowest cell steps down its diagonal
            dist += not d0 >> width - 1 & 1
        else:  # it stays on the pattern's last place and steps across
            at = m - 1 - j + k
            if at < 0:
                return False
            dist += (hp >> at & 1) - (hn >> at & 1)
        if j + k < m and dist > 2 * k + (n - m):
            return False
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, (d0 >> 1) & hp
    return dist <= k


def _matched(one: list[str], two: list[str], edits: int) -> np.ndarray:
    """Whether the lines of each pair are alike; lines of one length are first compared side by side."""
    n = np.array([[len(p), len(q)] for p, q in zip(one, two)], np.int64).reshape(-1, 2)
    ok = np.zeros(len(n), bool)
    same = np.flatnonzero((n[:, 0] == n[:, 1]) & (n[:, 0] > 0))
    if len(same):
        chars = lambda t: np.frombuffer("".join([t[i] for i in same]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = n[same, 0]
        differ = np.add.reduceat(chars(one) != chars(two), np.cumsum(size) - size, dtype=np.int64)
        ok[same] = differ <= np.minimum(edits, size // ALIKE)
    for i in np.flatnonzero(~ok):
        ok[i] = within(one[i], two[i], _alike(int(n[i].max()), edits))
    return ok


def _lines(body: bytes) -> list[bytes]:
    return [x for x in body.split(b"\n") if x and not x.isspace()]


def _alike(n: int, edits: int) -> int:
    """Edits allowed to a pair whose longer line has ``n`` code points."""
    return min(edits, n // ALIKE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def build(size=1 << max(16, n.bit_length())):
        one = np.full(size, _ODD, np.uint64)
        one[0] = 1
        back = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        back[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(one, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    if n > 2 * CHUNK_CHARS:  # one very long line; not kept
        return build(n)
    return C.process_cache(("powers",), lambda: build(2 * CHUNK_CHARS + 1))


def chunks(lines: list[str]):
    """Ranges of neighbouring lines that fit one batch."""
    at, size = 0, 0
    for i, x in enumerate(lines):
        if i > at and (i - at == CHUNK_LINES or size + len(x) > CHUNK_CHARS):
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(lines):
        yield at, len(lines)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Batch:
    """Lines side by side as code points, with prefix sums that give any substring's hash."""

    def __init__(self, lines: list[str]):
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = np.array([len(x) for x in lines], np.int64)
        self.at = np.cumsum(self.n) - self.n
        total = len(chars)
        power, self.back = _powers(total + 1)
        self.sums = np.zeros(total + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((chars + np.uint64(_SALT)) * power[:total], out=self.sums[1:])
            pair = _mix(chars[:-1] * np.uint64(0x10FFFF + 2) + chars[1:]) & np.uint64(63) if total else chars
        bits = np.zeros(total, np.uint64)
        bits[: max(total - 1, 0)] = np.uint64(1) << pair
        bits[(self.at + self.n - 1)[self.n > 0]] = 0  # pairs do not cross lines
        self.sketches = np.bitwise_xor.reduceat(bits, self.at) if len(lines) else bits

    def _keys(self, own, start, size, length, seg) -> np.ndarray:
        a = self.at[own] + start
        with np.errstate(over="ignore"):
            return _mix((self.sums[a + size] - self.sums[a]) * self.back[a] + _mix((length * 8 + seg).astype(np.uint64)))

    def keys(self, k: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(line, key)`` of all segments, or of all substrings probed; a key hashes length, segment and text.

        Only lines of the same or a shorter length are probed for, of ``MIN_CHARS`` code points at least.  A start is kept where both the left
        and the right side can still be aligned with the edits left over (position- and length-aware
        windows, ``lo`` to ``hi``).  Every line must have more than 2 * k characters.
        """
        lines, keys = [], []
        every = np.arange(len(self.n))
        for less in range(k + 1 if probe else 1):
            length = self.n - less
            base, more = np.divmod(length, k + 1)
            place = np.zeros_like(length)
            for seg in range(k + 1):
                size = base + (seg >= k + 1 - more)
                if probe:
                    lo = np.maximum(0, np.maximum(place - seg, place + less - (k - seg)))
                    hi = np.minimum(self.n - size, np.minimum(place + seg, place + less + (k - seg)))
                    hi = np.where(length < MIN_CHARS, -1, hi)
                else:
                    lo = hi = place
                for step in range(int((hi - lo).max(initial=-1)) + 1):
                    own = every[lo + step <= hi]
                    lines.append(own)
                    keys.append(self._keys(own, (lo + step)[own], size[own], length[own], seg))
                place = place + size
        return (np.concatenate(lines), np.concatenate(keys)) if lines else (every, np.zeros(0, np.uint64))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, row, pos, a, b``: each non-blank line of each text with 128 bits of hash.

    ``row`` is a hash of the text, so that rows that repeat a key stay apart unless they are equal.
    """
    C.small_batches(docs.sparkSession)
    src = C.pick(docs, key, text).select(F.col(key).alias("id"), C.raw_hash(text).alias("row"), F.col(text).cast("binary").alias("body"))
    schema = T.StructType(src.schema.fields[:2] + T._parse_datatype_string("pos int, a bigint, b bigint").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            at, pos, ids = [], [], []
            for i, body in enumerate(batch.column(2).to_pylist()):
                own = [xxhash.xxh3_128_digest(x) for x in _lines(body or b"")]
                at += [i] * len(own)
                pos += range(len(own))
                ids += own
            at = pa.array(at, pa.int32())
            hashes = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return src.mapInArrow(run, schema)


def _line_texts(docs: DataFrame, text: str, least: int) -> DataFrame:
    """``a, b, line``: the different lines of each task that may have links."""
    C.small_batches(docs.sparkSession)
    src = C.pick(docs, text).select(F.col(text).cast("binary").alias("body"))
    schema = T._parse_datatype_string("a bigint, b bigint, line string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, lines = [], []
            for body in batch.column(0).to_pylist():
                for line in _lines(body or b""):
                    if len(line) < least:
                        continue
                    h = xxhash.xxh3_128_digest(line)
                    if h not in seen:
                        seen.add(h)
                        ids.append(h)
                        lines.append(line.decode("utf-8", "replace"))
            hashes = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(lines, pa.string())], schema=arrow)

    return src.mapInArrow(run, schema)


def _key_rows(docs: DataFrame, text: str, k: int, least: int, probe: bool) -> DataFrame:
    """``k, a, s``: keys of all different lines of each task, the line's id and sketch."""
    C.small_batches(docs.sparkSession)
    src = C.pick(docs, text).select(F.col(text).cast("binary").alias("body"))
    schema = T._parse_datatype_string("k bigint, a bigint, s bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, lines = [], []
            for body in batch.column(0).to_pylist():
                for line in _lines(body or b""):
                    if len(line) < least:
                        continue
                    h = xxhash.xxh3_128_digest(line)
                    if h not in seen:  # copies in one task count once
                        seen.add(h)
                        t = line.decode("utf-8", "replace")
                        if len(t) >= least:
                            ids.append(h)
                            lines.append(t)
            for at, end in chunks(lines):
                own = Batch(lines[at:end])
                line, keys = own.keys(k, probe)
                a = np.frombuffer(b"".join(ids[at:end]), ">u8").astype(np.uint64)[::2][line]
                cols = [pa.array(x.view(np.int64)) for x in (keys, a, own.sketches[line])]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return src.mapInArrow(run, schema)


def _sorted_pair(p: str, q: str) -> list:
    return [F.least(p, q).alias("a1"), F.greatest(p, q).alias("a2")]


def _near(p: str, q: str, edits: int):
    """Whether sketches allow so many edits."""
    return F.bit_count(F.col(p).bitwiseXOR(F.col(q))) <= 4 * edits


def met_pairs(idx: DataFrame, prb: DataFrame, edits: int) -> DataFrame:
    """``a1, a2``: different lines that share a key and whose sketches allow ``edits`` edits; the test is part of the join."""
    one, two = (t.select("k", F.col("a").alias(f"a{i}"), F.col("s").alias(f"s{i}")) for i, t in ((1, idx), (2, prb)))
    return one.join(two, "k").where((F.col("a1") != F.col("a2")) & _near("s1", "s2", edits)).select(*_sorted_pair("a1", "a2")).distinct()


def _banded(rows: DataFrame, edits: int) -> DataFrame:
    """``k, band, ...``: rows once for each band of their sketch.

    Sketches within ``4 * edits`` bits agree in one of ``4 * edits + 1`` bands at least.
    """
    count = 4 * edits + 1
    width = 64 // count
    bands = [F.lit(i << 56).bitwiseOR(F.shiftrightunsigned("s", width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(count)]
    return rows.withColumn("band", F.explode(F.array(*bands)))


def _to_representatives(crowd: DataFrame, by: list[str], count: int, edits: int) -> DataFrame:
    """``a1, a2``: each line of ``crowd(by, a, s)`` with ``count`` representatives of its keys ``by``, where its sketch allows.

    They are the lines with the least hashes, the same hashes everywhere, so that keys with the same lines
    have the same ones.
    """
    one = [F.min(F.struct(F.xxhash64(F.lit(i), "a"), F.col("a").alias("a"), F.col("s").alias("s"))) for i in range(count)]
    reps = C.checkpointed(crowd.groupBy(*by).agg(F.count("*").alias("n"), F.array(*one).alias("reps")))
    each = C.hot_join(crowd, reps, by, "n", ("a",)).select("a", "s", F.explode("reps").alias("r"))
    each = each.select("a", "s", F.col("r.a").alias("ra"), F.col("r.s").alias("rs"))
    return each.where((F.col("a") != F.col("ra")) & _near("s", "rs", edits)).select(*_sorted_pair("a", "ra"))


def _other_pairs(crowd: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """``a1, a2``: lines of ``crowd(k, band, probe, a, s)`` of one key and band, one indexed and one probed, in different ``classes(a, root)``.

    Most lines of a crowded key are in one class by then; only lines outside the largest meet all others, so a
    key whose lines are all in one class gives nothing and is not gone through.
    """
    own = C.checkpointed(crowd.join(classes, "a", "left").withColumn("c", F.coalesce("root", "a")).drop("root"))
    kinds = own.groupBy("k", "band", "c").agg(F.count("*").alias("n"))
    top = C.checkpointed(kinds.groupBy("k", "band").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"))
    own = C.checkpointed(C.hot_join(own, top, ("k", "band"), "n", ("a",)).drop("n"))
    side = lambda i, cond: own.where(cond).select("k", "band", F.col("a").alias(f"a{i}"), F.col("s").alias(f"s{i}"), F.col("c").alias(f"c{i}"))
    stray = F.col("c") != F.col("top")
    apart = (F.col("c1") != F.col("c2")) & _near("s1", "s2", edits)
    got = side(1, ~F.col("probe") & stray).join(side(2, F.col("probe")), ["k", "band"]).where(apart)
    got = got.unionByName(side(1, ~F.col("probe") & ~stray).join(side(2, F.col("probe") & stray), ["k", "band"]).where(apart))
    return got.select(*_sorted_pair("a1", "a2")).distinct()


def _all_pairs(crowd: DataFrame, edits: int) -> DataFrame:
    """``a1, a2``: lines of ``crowd(k, a, s, probe)`` of one key, one indexed and one probed, whose sketches allow ``edits`` edits.

    They meet by bands of their sketches and count in the first band in which they agree.  The index rows of a key and band are
    dealt to blocks of ``BLOCK`` rows or so, which probes meet one by one, so no task meets a whole key.
    """
    rows = C.checkpointed(_banded(crowd, edits))
    large = C.checkpointed(rows.where("not probe").groupBy("k", "band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("k", "band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    blocks = F.coalesce("blocks", F.lit(1))
    own = rows.join(large, ["k", "band"], "left")
    own = own.withColumn("block", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), blocks).cast("int")))))
    side = lambda i, cond: own.where(cond).select("k", "band", "block", F.col("a").alias(f"a{i}"), F.col("s").alias(f"s{i}"))
    count = 4 * edits + 1
    width, x = 64 // count, F.col("s1").bitwiseXOR(F.col("s2"))
    first = [(F.shiftright("band", 56) <= j) | (x.bitwiseAND(F.lit((1 << width) - 1 << width * j)) != 0) for j in range(count - 1)]
    met = side(1, "probe").join(side(2, "not probe"), ["k", "band", "block"]).where((F.col("a1") != F.col("a2")) & _near("s1", "s2", edits))
    return met.where(reduce(lambda p, q: p & q, first, F.lit(True))).select(*_sorted_pair("a1", "a2"))


def _verified(docs: DataFrame, cand: DataFrame, text: str, edits: int, least: int) -> DataFrame:
    """``x, y``: struct ids (a, b) of the lines of ``cand(a1, a2)`` that are so alike, by their texts."""
    cand = C.checkpointed(cand)
    wanted = C.checkpointed(cand.select(F.explode(F.array("a1", "a2")).alias("a")).distinct())
    lines = C.likely_members(_line_texts(docs, text, least), wanted, "a").join(wanted, "a")
    texts = C.checkpointed(lines.groupBy("a", "b").agg(F.first("line").alias("line")))
    if (texts.agg(F.sum(F.octet_length("line") + 64)).first()[0] or 0) <= TEXT_BYTES:
        texts = F.broadcast(texts)
    one, two = (texts.select(F.col("a").alias(f"a{i}"), F.struct("a", "b").alias(f"n{i}"), F.col("line").alias(f"l{i}")) for i in (1, 2))
    pairs = cand.join(one, "a1").join(two, "a2").select(F.col("n1").alias("x"), F.col("n2").alias("y"), "l1", "l2")
    schema = T.StructType(pairs.schema.fields[:2])
    arrow = to_arrow_schema(schema)

    def verify(batches):
        for batch in batches:
            ok = _matched(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=arrow).filter(pa.array(ok))

    return C.checkpointed(pairs.mapInArrow(verify, schema))


def _met(docs: DataFrame, text: str, edits: int, least: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """``a1, a2`` of lines that meet by a key with at most ``crowd`` index rows, and ``k, a, s, probe`` of all other keys, none if there are none."""
    idx = C.checkpointed(_key_rows(docs, text, edits, least, False))
    prb = _key_rows(docs, text, edits, least, True)
    known = C.checkpointed(idx.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("k"))
    n = known.count()
    if not n:
        return met_pairs(idx, prb, edits), None
    known = F.broadcast(known) if n <= BROADCAST_KEYS else known
    both = idx.withColumn("probe", F.lit(False)).unionByName(prb.withColumn("probe", F.lit(True)))
    return met_pairs(idx.join(known, "k", "left_anti"), prb, edits), C.checkpointed(both.join(known, "k", "left_semi").distinct())


def links(docs: DataFrame, text: str = "text", edits: int = EDITS, least: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """``x, y``: struct ids (a, b) of all different lines that count as one, each pair once.

    Very many lines that are all alike have as many links as pairs; ``joining`` has enough of them for their classes.
    """
    pairs, whole = _met(docs, text, edits, least, crowd)
    if whole is not None:
        pairs = pairs.unionByName(_all_pairs(whole, edits)).distinct()
    return _verified(docs, pairs, text, edits, least)


def joining(docs: DataFrame, text: str = "text", edits: int = EDITS, least: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """Some of ``links``: enough to join all lines that they join.

    Lines of keys with at most ``crowd`` index rows are compared pair by pair.  Those of a crowded key are first
    linked to some representatives of the key and of each band of their sketch; what is in one class by then is not
    compared again, so very many lines that are all alike cost a few comparisons each.
    """
    pairs, whole = _met(docs, text, edits, least, crowd)
    if whole is None:
        return _verified(docs, pairs, text, edits, least)
    crowded = C.checkpointed(_banded(whole, edits))
    star = _to_representatives(whole, ["k"], REPS, edits).unionByName(_to_representatives(crowded, ["k", "band"], 1, edits)).distinct()
    stars = _verified(docs, star, text, edits, least)
    shared = stars.select(F.explode(F.array("x", "y")).alias("n")).distinct().groupBy("n.a").agg(F.count("*").alias("n")).where("n > 1").select("a")  # one number for two lines: not joined here
    safe = stars.select(F.col("x.a").alias("p"), F.col("y.a").alias("q")).join(shared.withColumnRenamed("a", "p"), "p", "left_anti").join(shared.withColumnRenamed("a", "q"), "q", "left_anti")
    classes = C.components(safe, "p", "q").withColumnRenamed("node", "a")
    return stars.unionByName(_verified(docs, pairs.unionByName(_other_pairs(crowded, classes, edits)).distinct(), text, edits, least))


def _numbered(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between 64-bit node numbers, and ``node, na, nb``; hashed anew if two nodes ever collide."""
    nodes = C.checkpointed(edge.select(F.explode(F.array("x", "y")).alias("n")).distinct())
    for seed in range(42, 99):
        number = lambda c: F.xxhash64(F.lit(seed), F.col(f"{c}.a"), F.col(f"{c}.b"))  # noqa: E731,B023
        named = nodes.select(number("n").alias("node"), F.col("n.a").alias("na"), F.col("n.b").alias("nb"))
        if named.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            break
    return edge.select(number("x").alias("x"), number("y").alias("y")), named


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, every: bool = False, **how) -> DataFrame:
    """``id, row, pos, a, b, ra, rb, again, first_id, n_links, n_near`` of lines whose class has several lines.

    A class is a component of links; equal lines are one node, ``(ra, rb)`` names the class and ``n_links`` counts
    its other different lines.  ``n_near`` counts the different lines that a line is itself linked to, if ``every`` link is to be found; else it is null.
    A class's first line is the one in the row with the smallest key (null keys last), rows that share
    a key in the order of a hash of their text, at the smallest place; all others stand ``again``.  Lines that
    stand alone are not listed.
    """
    occ = C.checkpointed(occurrences(docs, key, text))
    edge, named = _numbered(C.checkpointed((links if every else joining)(docs, text, edits, **how)))
    comp = C.components(edge, "x", "y")
    size = comp.groupBy("root").agg(F.count("*").alias("lines"))
    names = C.checkpointed(named.select(F.col("node").alias("root"), F.col("na").alias("ra"), F.col("nb").alias("rb")).join(size, "root"))
    root = C.hot_join(comp, names, ("root",), "lines", ("node",)).select("node", "ra", "rb", (F.col("lines") - 1).alias("n_links"))
    near = edge.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg((F.count("*") if every else F.lit(None).cast("long")).alias("n_near"))
    to = C.checkpointed(named.join(root, "node").join(near, "node").select("na", "nb", "ra", "rb", "n_links", "n_near"))
    own = occ.join(to, (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb")), "left").drop("na", "nb")
    own = own.withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    own = own.withColumn("n_near", F.coalesce("n_near", F.lit(0 if every else None).cast("long")))
    place = F.struct(F.col("id").isNull().alias("z"), "id", "row", "pos")
    first = C.checkpointed(own.groupBy("ra", "rb").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    out = C.hot_join(own, first, ("ra", "rb"), "n", ("id", "row", "pos"))
    return out.select("id", "row", "pos", "a", "b", "ra", "rb", (~place.eqNullSafe(F.col("first"))).alias("again"), F.col("first.id").alias("first_id"), "n_links", "n_near")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, every: bool = False, **how) -> DataFrame:
    """``key, n_lines, n_removed, n_links, n_near, first_ids, text``: texts without lines that stand earlier,
    exactly or nearly; for each line the key where its class first stands.  ``n_links`` sums up, for each line, the other
    different lines of its class: those it is one with, directly or through others.  ``n_near`` sums up those it is one with directly, if
    ``every`` link is to be found; else it is null.

    Two lines count as one within ``edits`` edits, if no more than one in ``ALIKE`` code points of the
    longer changes: a line under five code points has equal ones only, one under ten those one edit
    apart.  Blank lines stay.  Null texts stay null.  Rows equal in key and text are cut alike.
    """
    mark = F.struct("pos", "again", "first_id", F.col("n_links").alias("links"), F.col("n_near").alias("near"))  # as many as a text has lines
    drop = classes(docs, key, text, edits, every, **how).groupBy("id", "row").agg(F.sort_array(F.collect_set(mark)).alias("marks"))
    own = C.pick(docs, key, text).select(F.col(key).alias("id"), C.raw_hash(text).alias("row"), F.col(text).cast("binary").alias("body"))
    got = own.join(drop.withColumnsRenamed({"id": "di", "row": "dr"}), F.col("id").eqNullSafe(F.col("di")) & (F.col("row") == F.col("dr")), "left").select("id", "body", "marks")
    kind = own.schema["id"].dataType
    schema = T.StructType([T.StructField(key, kind)] + T._parse_datatype_string("n_lines bigint, n_removed bigint, n_links bigint, n_near bigint").fields + [T.StructField("first_ids", T.ArrayType(kind)), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            n, gone, deg, near, first, rest = [], [], [], [], [], []
            for key_, body, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                drop, at, keep = {m["pos"] for m in marks or () if m["again"]}, 0, []
                known = {m["pos"]: m["first_id"] for m in marks or ()}
                deg.append(sum(m["links"] for m in marks or ()))
                near.append(sum(m["near"] for m in marks or ()) if every else None)
                for line in (body or b"").split(b"\n"):
                    if line and not line.isspace():
                        at += 1
                        if at - 1 in drop:
                            continue
                    keep.append(line)
                n.append(at)
                first.append([known.get(i, key_) for i in range(at)])
                gone.append(len(drop))
                rest.append(None if body is None else b"\n".join(keep).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip((n, gone, deg, near, first, rest), list(arrow)[1:]))], schema=arrow)

    return got.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(C.table(spark, sf_dir, "documents"), every=True)
    return found.select("doc_id", "n_lines", "n_removed", "n_links", "n_near", "first_ids", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
