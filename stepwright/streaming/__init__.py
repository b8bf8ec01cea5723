"""The same operators on streams: row-wise ones unchanged, counts as streaming aggregations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.functions import steps as S
from stepwright.functions.segment import segment_steps
from stepwright.operators.quality import reject_reason
from stepwright.sources.jsonl import LOCALISED


def read_pairs(spark: SparkSession, path: str, schema: T.StructType = LOCALISED, files: int = 100) -> DataFrame:
    """A stream of pairs from JSON Lines files as they appear in a folder."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files).json(path)


def with_steps(stream: DataFrame, text: str = "rejected") -> DataFrame:
    return stream.withColumn("rejected_steps", segment_steps(F.col(text)))


def running_accuracy(details: DataFrame, by: str = "model") -> DataFrame:
    """``by, accuracy, correct, total`` so far; state is one row a model."""
    got = details.groupBy(by).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return got.select(by, (F.col("correct") / F.col("total")).alias("accuracy"), "correct", "total")


def running_rejects(stream: DataFrame, **how) -> DataFrame:
    """Rows so far for each reject reason, ``kept`` for none."""
    return reject_reason(stream, **how).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_rows"))


def windowed_rates(events: DataFrame, time: str, by: str, ok: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Success rates by event-time window; windows close, and their state goes, when the watermark passes."""
    w = F.window(time, width)
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.avg(F.col(ok).cast("double")).alias("rate"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "rate", "n")


#: Keys share so many states: a call of Python for each key costs a thousand times what its rows do.
BUCKETS = 1 << 12


def arriving_rates(events: DataFrame, key: str, tau: float = 0.3, buckets: int = BUCKETS) -> DataFrame:
    """``key, rates`` once for each key of ``events(key, k, n, rate)``, as soon as its first error is known.

    Rates of a key's ``n`` steps may come in any order and over any number of batches.  A row is
    out when all rates before a drop by more than ``tau`` and the two at it are there, or all ``n``; its ``rates`` are
    those up to there, of which ``functions.steps.localize`` makes what it makes of the whole.  A step that
    comes twice counts first; whatever comes after the row is out is dropped.  State is a key's rates until its
    row is out, then a mark.  It is held by bucket of a hash of the keys, and one call takes all the bucket's rows of a batch;
    a task holds one bucket at a time.
    """
    import pandas as pd

    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("rates", T.ArrayType(T.DoubleType()))])

    def settled(rates: dict[int, float], n: int) -> list[float] | None:
        had: list[float] = []
        for k in range(n):
            if k not in rates:
                return None
            had.append(rates[k])
            if k and min(1.0, max(0.0, had[-2])) - min(1.0, max(0.0, had[-1])) > tau:
                return had
        return had

    def run(group, batches: Iterator, state) -> Iterator:
        done, keys, steps, rates = state.get if state.exists else ([], [], [], [])
        done, held = set(done), {}
        for one, k, rate in zip(keys, steps, rates):
            held.setdefault(one, {})[k] = rate
        for pdf in batches:
            need, found = {}, {}
            for one, k, n, rate in zip(*(pdf[c].tolist() for c in ("key", "k", "n", "rate"))):
                one = None if one is None or one != one else one
                if one not in done:
                    held.setdefault(one, {}).setdefault(k, rate)
                    need.setdefault(one, n)
            for one, n in need.items():
                got = settled(held[one], n)
                if got is not None:
                    done.add(one)
                    del held[one]
                    found[one] = got
            if found:
                yield pd.DataFrame({key: pd.Series(list(found), dtype=object), "rates": list(found.values())})
        flat = [(one, k, rate) for one, own in held.items() for k, rate in own.items()]
        state.update((list(done), [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]))

    kept = T.StructType([T.StructField("done", T.ArrayType(kind)), T.StructField("keys", T.ArrayType(kind)), *T._parse_datatype_string("steps array<int>, rates array<double>").fields])
    own = events.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), F.col("k").cast("int").alias("k"), F.col("n").cast("int").alias("n"), F.col("rate").cast("double").alias("rate"))
    return own.groupBy("bucket").applyInPandasWithState(run, out, kept, "append", "NoTimeout")


def localise_arriving(events: DataFrame, key: str, tau: float = 0.3) -> DataFrame:
    """``key, n, first_error, confidence`` of each key of ``arriving_rates``, once; ``n`` steps were needed for it."""
    z = arriving_rates(events, key, tau).withColumn("z", S.localize(F.col("rates"), tau))
    return z.select(key, F.size("rates").alias("n"), F.col("z.first_error").alias("first_error"), F.col("z.confidence").alias("confidence"))
