"""What the corpus operators share: column picking, Arrow text maps, checkpoints, components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are runs of anything but ASCII white space; ``bytes.split()`` has the same separators.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; one of fewer splits than cores is dealt to all cores first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling, whatever other columns clash with them or with later names."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def small_batches(spark: SparkSession, rows: int = 256, size: int = 8 << 20) -> None:
    """Arrow batches of few rows that end with the row that passes ``size`` bytes, so that very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all of Spark is this process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _tidy(spark: SparkSession):
    """Within, finished executions delete their shuffle files at once, not when the driver collects its garbage, and only measured sizes make a broadcast.

    A planner takes rows before an explode for their size, so what it guesses to be small may fill the driver.
    Joins become broadcasts at run time where a side turns out to be small, or where the code asks for it.
    """
    guess, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(measured, None) or spark.conf.get(guess)
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", guess: "-1", measured: most}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder; shuffle files go at once."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def write(df: DataFrame, path: str) -> DataFrame:
    """The rows as a compressed table at ``path`` in the shared folder, read back; shuffle files go at once."""
    with _tidy(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared checkpoint folder for a written table."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table at a fresh shared path, read back."""
    return write(df, shared_path(df.sparkSession, what))


#: Rows of one key that a task should meet at most in ``hot_join``, and keys that may be hot at once.
HOT_ROWS, HOT_KEYS = 20_000, 1 << 15


def hot_join(rows: DataFrame, table: DataFrame, on: Sequence[str], n: str, spread: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to a materialised ``table`` with one row a key, whose column ``n`` counts the rows of the key.

    Keys above ``hot_rows`` rows stand in the table once for each so many rows, and a row of theirs
    takes one by a hash of ``spread`` and its partition.  The limit rises with the rows, so that at
    most ``HOT_KEYS`` keys are ever hot: that many rows are broadcast.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(hot_rows, -(-total // HOT_KEYS))
    copies = F.ceil(F.col(n) / limit).cast("int")
    hot = table.where(F.col(n) > limit).select(*on, copies.alias("_copies"))
    if hot.isEmpty():
        return rows.join(table, list(on), how)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *spread), F.col("_copies")).cast("int")
    own = rows.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_copies")
    many = table.withColumn("_salt", F.explode(F.when(F.col(n) > limit, F.sequence(F.lit(0), copies - 1)).otherwise(F.array(F.lit(0)))))
    return own.join(many, [*on, "_salt"], how).drop("_salt")


def likely_members(rows: DataFrame, wanted: DataFrame, hashed: str, words: int = 1 << 19) -> DataFrame:
    """Rows whose 64-bit hash may be among ``wanted``'s; all that are, and few others.

    A bitmap of ``64 * words`` bits by hash goes to the executors: at most ``words`` rows whatever the
    input.  When it fills up it lets more rows through and the exact join behind it works as before.
    """
    place = f"pmod(shiftright({hashed}, 6), {words})"
    bit = f"shiftleft(1L, cast({hashed} & 63 as int))"
    table = wanted.select(F.expr(place).alias("_i"), F.expr(bit).alias("_b")).groupBy("_i").agg(F.bit_or("_b").alias("_bits"))
    return rows.join(F.broadcast(table), F.expr(place) == F.col("_i")).where(F.expr(f"_bits & {bit} <> 0")).drop("_i", "_bits")


def raw_hash(text: str = "text"):
    """A hash of a text's bytes; with the key it names a row wherever keys repeat."""
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), F.col(text).isNull())


def without(docs: DataFrame, judged: DataFrame, key: str, text: str) -> DataFrame:
    """``docs``, all columns, less the rows that ``judged(key, raw, stays)`` drops.

    Rows are named by key and hash of the text, so a key that repeats with other texts is safe.  Of
    rows that repeat both, one stays.  Whole rows move once, against the names to drop.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    k, t = (F.col(f"_c{names.index(c)}") for c in (key, text))
    own = plain.withColumn("_k", k).withColumn("_raw", F.xxhash64(F.coalesce(t.cast("binary"), F.lit(b"")), t.isNull()))
    judged = checkpointed(judged.select(F.col(key).alias("_jk"), F.col("raw").alias("_jraw"), "stays"))
    same = (F.col("_raw") == F.col("_jraw")) & F.col("_k").eqNullSafe(F.col("_jk"))
    out = own.join(judged.where(~F.col("stays")), same, "left_anti")
    again = judged.where("stays").groupBy("_jk", "_jraw").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():
        once = out.join(again, same, "left_semi").dropDuplicates(["_k", "_raw"])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def process_cache(key: tuple, build: Callable):
    """One value for each key and Python process; survives that functions are pickled by value."""
    held = sys.__dict__.setdefault("_corpus_cache", {})
    if key not in held:
        held[key] = build()
    return held[key]


def map_texts(
    df: DataFrame, keep: Sequence[str], fields: Iterable[tuple[str, str]], fn: Callable[[list[bytes]], list], text: str = "text"
) -> DataFrame:
    """``keep`` plus the columns that ``fn`` makes of the whole texts as UTF-8 bytes; null texts are empty."""
    small_batches(df.sparkSession)
    src = pick(df, *keep, text).withColumn(text, F.col(text).cast("binary"))
    schema = T.StructType([src.schema[k] for k in keep] + T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields)
    arrow, width = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn([x or b"" for x in batch.column(width).to_pylist()])
            cols = [batch.column(i) for i in range(width)]
            cols += [pa.array(c, arrow.field(width + i).type) for i, c in enumerate(made)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return src.mapInArrow(run, schema)


def filter_texts(df: DataFrame, keep: Callable[[bytes], bool], text: str = "text") -> DataFrame:
    """The rows, all columns, whose whole text passes ``keep``; one pass, no join back."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([keep(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_())
            yield batch.filter(mask)

    return df.mapInArrow(run, df.schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds on DataFrames; only two numbers a round reach the
    driver.  Loops vanish (a node with loops only is absent from the result); null ends are dropped;
    an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").where("x <> m")
        nxt = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = checkpointed(nxt.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
