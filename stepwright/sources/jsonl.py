"""JSON Lines tables of preference pairs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", T.StringType()),
        T.StructField("rejected", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("metadata", T.VariantType()),
    ]
)
LOCALISED = T.StructType(
    [
        *PAIR.fields,
        T.StructField("rejected_steps", T.ArrayType(T.StringType())),
        T.StructField("first_error_step", T.IntegerType()),
        T.StructField("step_weights", T.ArrayType(T.DoubleType())),
        T.StructField("localization_confidence", T.DoubleType()),
        T.StructField("prefix_success_rates", T.ArrayType(T.DoubleType())),
        T.StructField("judge_rationale", T.StringType()),
        T.StructField("positive_prefix", T.StringType()),
        T.StructField("rejected_token_weights", T.ArrayType(T.DoubleType())),
        T.StructField("weighted_rejected_logp", T.DoubleType()),
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = LOCALISED, ordinal: str | None = None) -> DataFrame:
    """Rows of JSON Lines files; blank lines are skipped, a malformed line fails the read.

    Metadata are variants, so numbers, booleans, nulls and nested values keep their types (a whole number
    written with a fraction, ``1.0``, comes back as ``1``).  ``ordinal`` adds the row's position, see ``positions``.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return positions(df, ordinal) if ordinal else df


def positions(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """File rows with consecutive numbers, by path and then by place in the file, however the files are split.

    One pass counts the rows of each split; the splits' sums, a row for each of them, then shift the
    numbers that rows have within their split.  No task meets all rows and no row is moved for it.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    own = df.select("*", place.alias("_split"), F.monotonically_increasing_id().alias("_id"))
    before = F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))  # over splits
    splits = own.groupBy(F.col("_split").alias("_s")).agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    splits = splits.select("_s", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    return own.join(splits, F.col("_split") == F.col("_s")).withColumn(name, F.col("_before") + F.col("_id") - F.col("_low") + start).drop("_split", "_id", "_s", "_low", "_before")


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrite ``path`` with JSON Lines, nulls written out; ``by`` fans out to a folder for each value."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Increments:
    """A JSON Lines table that grows by committed increments, each key once.

    Below ``path`` an increment has a folder of rows in ``rows``, one of its keys in ``keys`` and, written last, one in
    ``manifest``.  Only increments in the manifest are read, so what a killed run has left is never
    seen, and is written over when its increment runs again.  An increment that is in the manifest is not
    run again.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def committed(self) -> list[str]:
        """The names of committed increments, from the manifest's file listing."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, what: str, schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{what}/{x}" for x in self.committed()]
        kind = self.spark.read.schema(schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return kind.option("mode", "FAILFAST").json(paths) if what == "rows" else kind.parquet(*paths)

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema)

    def append(self, name: str, rows: DataFrame) -> bool:
        """Write the rows of ``rows`` whose key no committed increment holds as increment ``name``; false if it is there already.

        Of rows that share a key one stays.  Known keys are read from their own column files, not from the rows.
        """
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith(("_", ".")):
            raise ValueError(f"not a folder's name: {name}")
        if name in self.committed():
            return False
        keys = T.StructType([self.schema[self.key]])
        fresh = rows.dropDuplicates([self.key]).join(self._read("keys", keys), self.key, "left_anti").select(*self.schema.names)
        write_jsonl(fresh, f"{self.path}/rows/{name}")
        self.spark.read.schema(keys).option("mode", "FAILFAST").json(f"{self.path}/rows/{name}").write.mode("overwrite").parquet(f"{self.path}/keys/{name}")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{name}")
        fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs_path)
        return True


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Append to the JSON Lines table at ``path`` the rows whose key it does not hold, each key once; made where it is not there.

    A run that was cut off is started again by the same call: files once committed are never rewritten.
    All keys are read from the rows; ``Increments`` keeps them apart and knows finished increments by name.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    if _exists(spark, path):
        rows = rows.join(read_jsonl(spark, path, T.StructType([rows.schema[key]])), key, "left_anti")
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; where it is unset, a temporary one of a local session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written once to a table in the shared folder (it stays until that is cleared) and read back, for those who read them more than once."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report with a header, numbers with four decimals."""
    cols = [F.format_string("%.4f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def as_metadata(**values) -> Column:
    """A metadata object of columns, each with its own type."""
    return F.to_variant_object(F.struct(*[v.alias(k) for k, v in values.items()]))


def as_pairs(df: DataFrame) -> DataFrame:
    """The pair columns: prompt, chosen and rejected must be there, metadata defaults to an empty object."""
    need = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast("string")).otherwise(F.col(c)).alias(c) for c in ("prompt", "chosen", "rejected")]
    have = df.columns
    answer = F.col("answer") if "answer" in have else F.lit(None).cast("string")
    meta = F.col("metadata") if "metadata" in have else F.lit(None).cast("variant")
    return df.select(*need, answer.alias("answer"), F.coalesce(meta, F.parse_json(F.lit("{}"))).alias("metadata"))


def metadata_map(meta: Column) -> Column:
    """``map<string,variant>`` of a metadata object; null or no object is an empty map."""
    return F.coalesce(F.try_variant_get(meta, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def merge_metadata(old: Column, new: Column) -> Column:
    """The union of two metadata objects, the new one's values first, null ones too; nested objects are values."""
    return F.to_variant_object(F.map_zip_with(metadata_map(old), metadata_map(new), lambda _, a, b: F.coalesce(b, a)))
