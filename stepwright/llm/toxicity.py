"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, from document labels."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled documents the model is fitted on at most, taken by hash of the id.
MAX_TRAIN = 10_000
#: Bytes of their texts at most, and of one text that is learnt from.
MAX_BYTES, MAX_TEXT = 1 << 28, 1 << 24
MIN_DOCS = 6
LEAST_Z = 4.0
THRESHOLD = 0.7
#: Sentences at or above this score are reported as offending.
SENTENCE = 0.5
_END = r"(?<=[.!?])\s+|\n+"
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, in characters; none for blank texts."""
    end = C.process_cache(("sentence",), lambda: re.compile(_END))
    out, at = [], 0
    for m in end.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if b > a and not text[a:b].isspace()]


def words(sentence: str) -> set[str]:
    """Features of a sentence: its words without punctuation, and five-letter stems marked ``^``."""
    own = {w.strip(_EDGE) for w in sentence.lower().split()}
    return own | {"^" + w[:5] for w in own if len(w) > 5}


class Model:
    """Word weights and a bias of the sentence scorer; only words with a weight are kept."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def sentence_logit(self, sentence: str) -> float:
        own = self.weights
        return self.bias + sum([own[w] for w in words(sentence) if w in own])


def fit(texts: list[str], labels: list[int], epochs: int = 500, decay: float = 1e-5, rate: float = 0.1, min_docs: int = MIN_DOCS, least_z: float = LEAST_Z) -> Model:
    """Fit sentence weights to document labels through noisy-or by full-batch Adam with weight decay.

    Equal texts count once (with their largest label).  Features are the words that stand in at least
    ``min_docs`` texts and in toxic ones ``least_z`` standard deviations more often than by chance.
    log(1 - P(doc)) is the sum over sentences of log(1 - p), so the gradient of a sentence's logit is p
    for a clean document and -(1 - P) / P * p for a toxic one.  Without both classes no word has a weight
    and each sentence scores the base rate; without any text that is next to zero.
    """
    once: dict[str, int] = {}
    for t, label in zip(texts, labels):
        once[t] = max(once.get(t, 0), label)
    texts, y = list(once), np.array(list(once.values()), float)
    if len(y) == 0 or y.min() == y.max():
        base = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log(max(base, 1e-6) / max(1 - base, 1e-6))))
    seen, hits = Counter(), Counter()
    for t, label in zip(texts, y):
        own = set().union(*(words(t[a:b]) for a, b in sentences(t)))
        seen.update(own)
        if label:
            hits.update(own)
    rate_y = y.mean()
    chosen = sorted(w for w, c in seen.items() if c >= min_docs and hits[w] - c * rate_y >= least_z * math.sqrt(c * rate_y * (1 - rate_y)))
    index, vocab = {w: i for i, w in enumerate(chosen)}, len(chosen)
    del seen, hits
    tok, sent_len, doc_len = [], [], []
    for t in texts:
        spans = sentences(t)
        for a, b in spans:
            ids = [index[w] for w in words(t[a:b]) if w in index]
            tok += ids
            sent_len.append(len(ids))
        doc_len.append(len(spans))
    tok_all, n_sent, n_doc = np.array(tok, np.int64), len(sent_len), len(y)
    sent_of = np.repeat(np.arange(n_sent), sent_len)
    doc_of = np.repeat(np.arange(len(doc_len)), doc_len)
    w, b = np.zeros(vocab), -5.0
    m, v, mb, vb = np.zeros(vocab), np.zeros(vocab), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = b + np.bincount(sent_of, weights=w[tok_all], minlength=n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=n_doc)  # -log(1 - P)
        toxic = np.maximum(-np.expm1(-clean), 1e-9)
        pull = np.where(y == 1, -np.exp(-clean) / toxic, 1.0) / n_doc
        g = pull[doc_of] * p
        gw, gb = np.bincount(tok_all, weights=g[sent_of], minlength=vocab), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        scale = np.sqrt(v / c2) + 1e-8
        w -= rate * ((m / c1) / scale + decay * w)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(dict(zip(chosen, w.tolist())), float(b))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN, **how) -> Model:
    """Fit on at most about ``max_train`` labelled documents outside the held-out third, chosen by hash.

    Null labels and labels without a document don't count; of repeated labels the largest counts, of
    repeated documents the smallest text.  Texts above ``MAX_TEXT`` bytes are not learnt from, and where
    all would be more than ``MAX_BYTES`` a share of them by hash is.
    """
    lab = C.pick(labels, key, label).where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    lab = lab.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    n = lab.count()
    if n > max_train:
        share = int(max_train / n * (1 << 20))
        lab = lab.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share)
    # about ``max_train`` labels are left, so the broadcast and what follows are bounded
    got = C.pick(docs, key, "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TEXT).join(F.broadcast(lab), key)
    got = C.checkpointed(got.groupBy(key).agg(F.min("text").alias("text"), F.max("y").alias("y")))  # one row a document
    size = got.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BYTES:
        got = got.where(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 20)) < int(MAX_BYTES / size * (1 << 20)))
    got = got.select("text", "y").toArrow()
    order = sorted(zip((t or "" for t in got["text"].to_pylist()), got["y"].to_pylist()))
    return fit([t for t, _ in order], [y for _, y in order], **how)


def score(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text", at_least: float = SENTENCE) -> DataFrame:
    """``keep, score, spans``: noisy-or over all sentences and the offending sentences' character spans.

    Null and blank texts have no sentence and score zero.  One row for each input row.
    """
    weights, bias = model.weights, model.bias

    def fn(texts: list[bytes]) -> list:
        own = Model(weights, bias)
        scores, spans = [], []
        for raw in texts:
            t = raw.decode("utf-8", "replace")
            total, found = 0.0, []
            for a, b in sentences(t):
                z = own.sentence_logit(t[a:b])
                total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                p = 1 / (1 + math.exp(-max(z, -700.0)))
                if p >= at_least:
                    found.append({"start": a, "end": b, "p": float(p)})
            scores.append(-math.expm1(-total))
            spans.append(found)
        return [scores, spans]

    return C.map_texts(docs, keep, [("score", "double"), ("spans", "array<struct<start:int,end:int,p:double>>")], fn, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    s = score(docs, model)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_offending"))
