"""Byte-level BPE encoding and decoding with tiktoken over a local rank file."""

from __future__ import annotations

import base64
import hashlib

import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts above this many characters are cut at safe boundaries before the library sees them.
LONG = 1 << 16
#: No match of the pattern spans a place where ASCII white space follows a letter or digit, nor one
#: between an ASCII letter and a digit: every alternative takes white space only in front, and none
#: holds letters and numbers together.  Classes on which Unicode versions could differ are left out.
_SAFE = r"(?<=[\p{L}0-9])(?=[ \t\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; one for each process."""

    def build():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return C.process_cache(("bpe", path, pattern), build)


def pieces(text: str, long: int = LONG):
    """The text in pieces of about ``long`` characters, cut at safe boundaries only.

    A run without any boundary stays whole: results never depend on ``long``.
    """
    if len(text) <= long:
        yield text
        return
    safe = C.process_cache(("safe",), lambda: regex.compile(_SAFE))
    start = 0
    while len(text) - start > long:
        m = safe.search(text, start + long)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str, enc, long: int = LONG) -> list[int]:
    if len(text) <= long:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, long):
        ids += enc.encode_ordinary(piece)
    return ids


def _of(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, keep=("doc_id",), path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``keep`` and ``ids array<int>`` of every whole text; the rank file is read on each executor.

    Null and empty texts give no ids.  Invalid UTF-8 is read with replacement characters.  One row out
    for each row in, repeated rows included; other columns are ignored.
    """
    path, pattern = _of(path, pattern)

    def fn(texts: list[bytes]) -> list:
        enc = encoding(path, pattern)
        return [[encode(t.decode("utf-8", "replace"), enc) for t in texts]]

    return C.map_texts(docs, keep, [("ids", "array<int>")], fn, text)


def decode_documents(encoded: DataFrame, keep=("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` and ``bytes binary``: raw bytes of ``ids``; null ids give empty bytes, unknown ids raise."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    path, pattern = _of(path, pattern)
    src = C.pick(encoded, *keep, "ids")
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField("bytes", T.BinaryType())])
    arrow, width = to_arrow_schema(schema), len(keep)

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            out = [enc.decode_bytes(x or []) for x in b.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(out, pa.binary())], schema=arrow)

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep=("doc_id",), path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``keep, n_tokens, ids_sha256, decoded_sha256``.

    Ids are hashed as decimals joined by commas.  Null texts count as empty: no tokens, both hashes of
    the empty string.  No state but the vocabulary is held; memory is bounded by the largest text.
    """
    path, pattern = _of(path, pattern)

    def fn(texts: list[bytes]) -> list:
        enc = encoding(path, pattern)
        names = C.process_cache(("names", path), lambda: [b"%d" % i for i in range(enc.n_vocab)])
        n, ids_hash, out_hash = [], [], []
        for t in texts:
            ids = encode(t.decode("utf-8", "replace"), enc)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
            out_hash.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return [n, ids_hash, out_hash]

    return C.map_texts(docs, keep, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], fn, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.table(spark, sf_dir, "documents"))
