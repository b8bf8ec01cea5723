"""Spelling variants by full neighbourhood generation over the vocabulary of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

RUN = r"[A-Za-zÀ-ÿ]+"
#: A word has at least so many code points and stands so often; one run in ``SLIPS`` loses a code point.
MIN_CHARS, MIN_COUNT, SLIPS = 5, 3, 97
#: A form stands at least so many times as often as the word.
TIMES = 2
#: Bits for each word in the bitmap that thins neighbours before they are moved, and its greatest size (16 MB).
BITS, MAX_BITS, PROBES = 32, 1 << 27, 3
#: Neighbours that are hashed side by side.
CELLS = 1 << 21
_P = 0x9E3779B97F4A7C15
_BACK = pow(_P, -1, 1 << 64)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, of whole texts; some lose a code point by the crc32 of key and run.

    Null texts have no runs; a null key counts as empty text.  Words of ``MIN_CHARS`` code points and
    ``MIN_COUNT`` occurrences stay.  Counts are combined in each task before they move.
    """
    own = C.pick(docs, key, text).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("raw"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", upper, lower))
    own = own.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr(f"if(h % {SLIPS} = 0, concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2)), run)")
    return own.select(cut.alias("word")).where(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _P, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a hash in a bitmap of ``bits``, a power of two."""
    m = _mix(h)
    step = m >> np.uint64(32) | np.uint64(1)
    return [m + np.uint64(k) * step & np.uint64(bits - 1) for k in range(PROBES)]


class Bitmap:
    """A set of hashes of bounded size that may take strangers for members."""

    def __init__(self, raw: bytes):
        self.cells = np.frombuffer(raw, np.uint8)
        self.bits = 8 * len(raw)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Where the flat array ``h`` may hold members."""
        at = np.arange(len(h))
        for k in range(PROBES):  # the few that passed one probe are tried again
            place = _places(h[at], self.bits)[k]
            at = at[(self.cells[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return at


def _by_length(texts: list[str]):
    """``(indices, code points)`` of the words of each length, few enough for one batch."""
    size = np.array([len(x) for x in texts])
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        step = max(1, (1 << 18) // max(n, 1))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            yield part, np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.uint64)


def hashes(texts: list[str]) -> np.ndarray:
    """Polynomial hashes of words modulo 2^64."""
    out = np.zeros(len(texts), np.uint64)
    with np.errstate(over="ignore"):
        for at, chars in _by_length(texts):
            out[at] = (chars * _powers(chars.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
    return out


def neighbours(texts: list[str], alphabet: str, keep) -> tuple[list[int], list[str]]:
    """``(index, neighbour)`` of all distinct words one deletion, replacement or insertion away that ``keep`` lets through.

    ``keep`` gets hashes and gives the places of those that may be wanted.  A deletion within a run of one
    letter counts at the run's start, an insertion before the same letter's run only, so no
    neighbour comes twice.
    """
    letters = np.array([ord(c) for c in alphabet], np.uint64)
    own, near = [], []

    def take(h, valid, part, start, make):
        flat = np.flatnonzero(valid.ravel())
        for at in flat[keep(h.ravel()[flat])].tolist():
            r, rest = divmod(at, int(np.prod(h.shape[1:])))
            i, c = divmod(rest, h.shape[2]) if h.ndim == 3 else (rest, 0)
            own.append(int(part[r]))
            near.append(make(texts[part[r]], start + i, alphabet[c] if h.ndim == 3 else ""))

    with np.errstate(over="ignore"):
        for rows, points in _by_length(texts):
            n = points.shape[1]
            power = _powers(n + 1)
            places = max(1, min(n + 1, CELLS // max(1, len(letters))))
            step = max(1, CELLS // (places * max(1, len(letters))))
            for k in range(0, len(rows), step):
                part, x = rows[k : k + step], points[k : k + step]
                pre = np.zeros((len(part), n + 1), np.uint64)
                np.cumsum(x * power[:n], axis=1, dtype=np.uint64, out=pre[:, 1:])
                full = pre[:, -1:]
                same = np.zeros((len(part), n), bool)
                same[:, 1:] = x[:, 1:] == x[:, :-1]
                take(pre[:, :-1] + (full - pre[:, 1:]) * np.uint64(_BACK), ~same, part, 0, lambda w, i, c: w[:i] + w[i + 1 :])
                for s in range(0, n + 1, places):
                    e = min(s + places, n)
                    if e > s:
                        old = x[:, s:e, None]
                        take(full[:, :, None] + (letters - old) * power[s:e, None], letters != old, part, s, lambda w, i, c: w[:i] + c + w[i + 1 :])
                    e = min(s + places, n + 1)
                    head = pre[:, s:e, None]
                    before = np.zeros((len(part), e - s), np.uint64)  # the letter to the left; none at the start
                    before[:, max(0, 1 - s) :] = x[:, max(s - 1, 0) : e - 1]
                    take(head + letters * power[s:e, None] + (full[:, :, None] - head) * np.uint64(_P), letters != before[:, :, None], part, s, lambda w, i, c: w[:i] + c + w[i:])
    return own, near


def _bitmap(vocabulary: DataFrame, n: int) -> bytes:
    """The bitmap of the vocabulary's hashes, put together from sums of bits by slot."""
    bits = min(MAX_BITS, 1 << max(16, (BITS * n - 1).bit_length()))
    schema = T._parse_datatype_string("slot int, bits bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        cells = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for place in _places(hashes(batch.column(0).to_pylist()), bits):
                np.bitwise_or.at(cells, (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        wide = cells.view(np.int64)
        at = np.flatnonzero(wide)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(wide[at])], schema=arrow)

    got = vocabulary.select("word").mapInArrow(run, schema).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, near, m``: all pairs of ``vocabulary(word, n)`` one edit apart, both ways, ``m`` the near word's ``n``.

    Every word's full neighbourhood over the letters that the vocabulary holds (some 90 at most) is made and
    met with the vocabulary by equality, so nothing is left to verify.  A word has at most about 90 near
    words for each of its places.  Before the join a bitmap of bounded size thins the neighbours; it
    decides nothing, and where a vocabulary outgrows it more neighbours move.
    """
    spark = vocabulary.sparkSession
    n = vocabulary.count()
    alphabet = "".join(sorted(r.c for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() if r.c))
    known = spark.sparkContext.broadcast(_bitmap(vocabulary, n))
    schema = T._parse_datatype_string("word string, near string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        table = Bitmap(known.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own, near = neighbours(texts, alphabet, table.has)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(near, pa.string())], schema=arrow)

    C.small_batches(spark, 2048)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    made = vocabulary.select("word").repartition(tasks, F.xxhash64("word")).mapInArrow(run, schema)
    return made.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: each word of ``forms(word, form)`` with the last form reached from it.

    Pointers double each round.  A word that points at a last form is done and meets no join again, so
    forms that very many words end at gather none of them.  A form stands more often than its word, so there are no circles.
    """
    inner = forms.select(F.col("word").alias("form"), F.lit(True).alias("_open"))
    now = C.checkpointed(forms.join(inner, "form", "left").select("word", F.col("form").alias("root"), F.coalesce("_open", F.lit(False)).alias("open")))
    while not now.where("open").isEmpty():
        todo = now.where("open")
        to = now.select(F.col("word").alias("w"), F.col("root").alias("r"), F.col("open").alias("o"))
        now = C.checkpointed(now.where("not open").unionByName(todo.join(to, F.col("root") == F.col("w")).select("word", F.col("r").alias("root"), F.col("o").alias("open"))))
    return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the corpus vocabulary; see ``words`` for what counts.

    A form is the near word of largest ``n`` (ties: smallest by code points), if it stands at least
    ``TIMES`` as often as the word.  Empty tables and texts without words give an empty result; rows that
    repeat count each time.
    """
    vocabulary = C.checkpointed(words(docs, key, text))
    best = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("best"))
    own = vocabulary.join(best, "word", "left")
    formed = -F.col("best.m") >= TIMES * F.col("n")
    own = C.checkpointed(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")))
    out = own.join(roots(own.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT row_number() OVER () AS r, id, run, count(*) AS n, id || ':' || run AS s FROM runs GROUP BY id, run),
bytes AS (SELECT r, b, row_number() OVER (PARTITION BY r ORDER BY i DESC, j DESC) - 1 AS k FROM (
  SELECT r, i, unnest(CASE WHEN c < 128 THEN [1] ELSE [1, 2] END) AS j, unnest(CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END) AS b
  FROM (SELECT r, unnest(range(length(s))) AS i, ord(unnest(string_split(s, ''))) AS c FROM own))),
one AS (SELECT x AS b, list_reduce([x::BIGINT] || range(8), lambda v, s: xor(v >> 1, (v & 1) * 3988292384)) AS v FROM range(256) t(x)),
longest AS (SELECT max(n) AS n FROM (SELECT r, count(*) AS n FROM bytes GROUP BY r)),
tab(k, b, v) AS (SELECT 0, b, v FROM one UNION ALL SELECT 0, 256, 4294967295
  UNION ALL SELECT t.k + 1, t.b, xor(t.v >> 8, one.v) FROM tab t JOIN one ON one.b = t.v & 255 WHERE t.k < (SELECT n FROM longest)),
crc AS (SELECT r, xor(xor(bit_xor(t.v), any_value(f.v)), 4294967295) AS h FROM (SELECT *, count(*) OVER (PARTITION BY r) AS n FROM bytes) x JOIN tab t ON t.k = x.k AND t.b = x.b JOIN tab f ON f.k = x.n AND f.b = 256 GROUP BY r),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM own JOIN crc USING (r)),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
spot AS MATERIALIZED (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM spot),
mask AS (SELECT word, i, substr(word, 1, i - 1) || '.' || substr(word, i + 1) AS x FROM spot),
near AS MATERIALIZED (SELECT less.word AS word, v.word AS other FROM less JOIN v ON v.word = less.x UNION ALL SELECT v.word, less.word FROM less JOIN v ON v.word = less.x
  UNION ALL SELECT a.word, b.word FROM mask a JOIN mask b ON a.x = b.x AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, n_near, other, m FROM (SELECT near.word, other, v.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS rk FROM near JOIN v ON v.word = other) WHERE rk = 1),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, at_, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.at_ WHERE f.form IS NOT NULL)
SELECT f.word, form, w.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(at_, step) AS root FROM walk GROUP BY word) w USING (word)
"""
