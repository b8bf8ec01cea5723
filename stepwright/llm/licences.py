"""Licence scan: trained paragraph classifier over word n-grams, confirmed against templates."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Short notices of each family, as people put them into files; ``unknown`` has none.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "SPDX-License-Identifier: Unlicense"),
    "reserved": ("All rights reserved.", "Copyright (c) 2020 Example Company. All rights reserved."),
}
FAMILIES = (*sorted(TEMPLATES), "unknown")
#: Documents whose paragraphs teach the unknown class at most; families are learnt from templates.
MAX_TRAIN = 600
#: Paragraphs of theirs at most and words of those that stand around notices in training, both by hash of their text; texts
#: above so many bytes are not learnt from.
PARAGRAPHS, FILLER, MAX_TEXT = 6_000, 2_000, 1 << 18
GRAMS = 3
#: Windows whose judgement a task keeps.
JUDGED = 1 << 14
#: A prediction counts from this calibrated probability, if this share of some template's or of the
#: paragraph's own n-grams is shared; the latter for paragraphs of so many words, as shorter ones
#: ("Version 2.0", "the following conditions") are in templates by chance.
LEAST_P, LEAST_MATCH, LEAST_OWN = 0.5, 0.6, 8
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def tokens(paragraph: str) -> list[str]:
    token = C.process_cache(("licence token",), lambda: re.compile(_TOKEN))
    return token.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(g) for n in range(1, GRAMS + 1) for g in zip(*(words[i:] for i in range(n)))]


def paragraphs(text: str):
    """``(start, end)`` of each non-blank line."""
    at = 0
    for line in text.split("\n"):
        if line and not line.isspace():
            yield at, at + len(line)
        at += len(line) + 1


class Templates:
    """The templates' n-grams, and where in a text one may stand on one line or across wrapped lines."""

    def __init__(self, templates: list[tuple[str, frozenset]]):
        self.templates = templates
        self.sizes = [len(t) for _, t in templates]
        self.of: dict[str, list[int]] = {}  # the templates that hold an n-gram
        for k, (_, t) in enumerate(templates):
            for g in t:
                self.of.setdefault(g, []).append(k)
        self.longest = max(sum(" " not in g for g in t) + 8 for _, t in templates)  # words may repeat
        # what a line must hold of a template to share LEAST_MATCH: one of its pairs, unless single words suffice
        self.pairs = frozenset(tuple(g.split(" ")) for _, t in templates for g in t if g.count(" ") == 1)
        words = [frozenset(g for g in t if " " not in g) for _, t in templates]
        self.rare = frozenset().union(*(w for w, (_, t) in zip(words, templates) if len(w) >= LEAST_MATCH * len(t)))

    def _shared(self, own) -> list[int]:
        n = [0] * len(self.sizes)
        for g in own:
            for k in self.of.get(g, ()):
                n[k] += 1
        return n

    def share(self, own, family: str | None = None) -> float:
        """The largest share of a template's n-grams that are among ``own``."""
        return max((n / size for n, size, (f, _) in zip(self._shared(own), self.sizes, self.templates) if family in (None, f)), default=0.0)

    def own_share(self, own, family: str) -> float:
        return max((n / max(len(own), 1) for n, (f, _) in zip(self._shared(own), self.templates) if f == family), default=0.0)

    def warm(self, lines: list[list[str]]) -> list[bool]:
        """Whether a template's pair ends in the line."""
        last, out = None, []
        for ws in lines:
            out.append(bool(ws) and (not self.pairs.isdisjoint(zip(ws, ws[1:])) or (last, ws[0]) in self.pairs or not self.rare.isdisjoint(ws)))
            last = ws[-1] if ws else None
        return out

    def ends(self, lines: list[list[str]]) -> list[list[tuple[int, str]]]:
        """By line: the templates' n-grams that end in it, each with the line it begins in; none reaches over a line without words."""
        out, back = [], []  # back: the last words with their lines
        for k, ws in enumerate(lines):
            found: list[tuple[int, str]] = []
            if not ws:
                back = []
            for w in ws:
                back = [*back[1 - GRAMS :], (k, w)]
                g = ""
                for line, x in reversed(back):
                    g = f"{x} {g}" if g else x
                    if g in self.of:
                        found.append((line, g))
            out.append(found)
        return out

    def windows(self, lines: list[list[str]], warm: list[bool], ends: list[list[tuple[int, str]]]):
        """``(i, j, n-grams)`` of neighbouring lines ``i..j`` that may hold a template together; a line without words parts them.

        A window's known n-grams and what each template has of them grow line by line.
        """
        seen = [0]
        for w in warm:
            seen.append(seen[-1] + w)
        for i in range(len(lines)):
            inner, j, own, n, best = 0, i + 1, set(), [0] * len(self.sizes), 0.0
            grown = i
            while lines[i] and j < len(lines) and lines[j] and inner < self.longest:
                while grown <= j:
                    for line, g in ends[grown]:
                        if line >= i and g not in own:
                            own.add(g)
                            for k in self.of[g]:
                                n[k] += 1
                                best = max(best, n[k] / self.sizes[k])
                    grown += 1
                if seen[j + 1] > seen[i] and best >= LEAST_MATCH:
                    yield i, j, frozenset(own)
                inner += len(lines[j])
                j += 1


def _lines(text: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Spans and words of the lines; blank lines have an empty span and no words."""
    at, words, end = [], [], 0
    for a, b in paragraphs(text):
        if at and text.count("\n", end, a) > 1:
            at.append((a, a))
            words.append([])
        at.append((a, b))
        words.append(tokens(text[a:b]))
        end = b
    return at, words


class Model:
    """Sparse weights ``gram -> one weight for each family``, biases, temperature and template grams."""

    def __init__(self, weights: dict[str, tuple], bias: tuple, heat: float, templates: list[tuple[str, frozenset]]):
        self.weights, self.bias, self.heat, self.templates = weights, bias, heat, templates
        self.known = Templates(templates)
        self.place, self.rows = {g: i for i, g in enumerate(weights)}, np.array(list(weights.values())).reshape(len(weights), -1)
        self.judged: dict[frozenset, tuple] = {}  # by a window's n-grams: bundles repeat their notices
        self.unknown = self.probabilities([])  # of a paragraph without any known n-gram

    def probabilities(self, found: list[str]) -> list[float]:
        z = np.array(self.bias, float)
        if found:
            z = z + self.rows[[self.place[g] for g in found]].sum(axis=0) / math.sqrt(len(found))
        z = z / self.heat
        p = np.exp(z - z.max())
        return (p / p.sum()).tolist()

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """``(family, probability, match)``; unknown where the classifier or the templates say so."""
        words = tokens(paragraph)
        own = set(grams(words)) if any(w in self.weights for w in words) else set()
        family, p, match = self.judge(own)
        if family == "unknown" and len(words) >= LEAST_OWN:
            return self.judge(own, self.known.own_share)
        return family, p, match

    def judge(self, own: set, share=None) -> tuple[str, float, float]:
        """Of a paragraph's n-grams, confirmed by ``share``: of a template's n-grams if none is given."""
        found = sorted(g for g in own if g in self.weights)
        if not found:
            return "unknown", self.unknown[-1], 0.0
        p = self.probabilities(found)
        best = int(np.argmax(p))
        if FAMILIES[best] == "unknown" or p[best] < LEAST_P:
            return "unknown", p[-1], 0.0
        match = (share or self.known.share)(own, FAMILIES[best])
        if match < LEAST_MATCH:
            return "unknown", p[-1], match
        return FAMILIES[best], p[best], match

    def find(self, text: str) -> list[tuple[str, int, int, float, float]]:
        """``(family, start, end, probability, match)`` of lines and runs of lines, in order.

        Lines that share enough of a template come first.  Then come neighbouring lines that share more of
        one than without their first or last, the best first; they overlap none of their own family.  Other
        lines count that share enough of their own n-grams with one.  What the last two steps find right
        beside a match of its family is taken for more of that notice.
        """
        at, lines = _lines(text)
        warm = self.known.warm(lines)
        if not any(warm):
            return []
        own = {k: set(grams(lines[k])) for k, w in enumerate(warm) if w}
        taken = {(k, k): m for k, o in own.items() if (m := self.judge(o))[0] != "unknown"}
        covered = {f: bytearray(len(lines)) for f in (*FAMILIES, None)}  # None: by any family

        def cover(i, j, family):
            for f in (family, None):
                covered[f][i : j + 1] = b"\1" * (j + 1 - i)

        for (k, _), m in taken.items():
            cover(k, k, m[0])
        several, whole = [], set(taken)
        ends = self.known.ends(lines)
        within = lambda a, b: {g for line in range(a, b + 1) for first, g in ends[line] if first >= a}
        for i, j, o in self.known.windows(lines, warm, ends):
            m = self.judged.get(o)
            if m is None:
                if len(self.judged) >= JUDGED:
                    self.judged.clear()
                m = self.judged[o] = self.judge(o)
            if m[0] != "unknown" and all(self.known.share(within(a, b), m[0]) < m[2] for a, b in ((i, j - 1), (i + 1, j))):
                several.append((-m[2], j - i, i, j, m))
        for _, _, i, j, m in sorted(several):
            if not any(covered[m[0]][i : j + 1]):
                taken[i, j] = m
                cover(i, j, m[0])
        for k, o in own.items():
            if len(lines[k]) >= LEAST_OWN and not covered[None][k]:
                m = self.judge(o, self.known.own_share)
                if m[0] != "unknown":
                    taken[k, k] = m
        out, after = [], {}  # by family: the line behind its last match, that match's place, whether it is a whole line
        for (i, j), (family, p, match) in sorted(taken.items()):
            line, k, alone = after.get(family, (None, None, None))
            if line == i and not (alone and (i, j) in whole):
                out[k] = (family, out[k][1], at[j][1], max(p, out[k][3]), max(match, out[k][4]))
                after[family] = j + 1, k, False
            else:
                after[family] = j + 1, len(out), (i, j) in whole
                out.append((family, at[i][0], at[j][1], p, match))
        return out


def _by_hash(text: str) -> tuple[int, str]:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")), text


def _variants(text: str, rng: np.random.Generator, filler: list[str]) -> list[str]:
    """A notice as it turns up: whole, with a year or a name, words lost, text around it."""
    words = text.split()
    out = [text, text.upper(), f"Copyright {2000 + int(rng.integers(30))}. {text}"]
    for _ in range(4):
        kept = [w for w in words if rng.random() > 0.08]
        pick = lambda: [filler[int(i)] for i in rng.integers(len(filler), size=int(rng.integers(8)))] if filler else []
        out.append(" ".join([*pick(), *kept, *pick()]))
    return out


def _templates() -> list[tuple[str, frozenset]]:
    return [(f, frozenset(grams(tokens(t)))) for f, ts in sorted(TEMPLATES.items()) for t in ts]


def _clean(text: str, known: Templates) -> list[str]:
    """The lines that do not hold a template together with their neighbours."""
    at, lines = _lines(text)
    bad = {k for i, j, _ in known.windows(lines, known.warm(lines), known.ends(lines)) for k in range(i, j + 1)}
    return [text[a:b] for k, (a, b) in enumerate(at) if a < b and (k not in bad or not known.warm([lines[k]])[0])]


def fit(background: list[str], seed: int = 0, epochs: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Multinomial logistic regression on templates' variants and background paragraphs.

    The vocabulary is the templates' n-grams, so weights stay sparse whatever the background.  Background
    paragraphs that hold a whole template are left out of the unknown class.  The temperature that makes
    probabilities fit their accuracy is set on templates, with all their variants, and a fifth of the
    background that a first fit has not seen; the second fit learns from all rows.
    """
    rng = np.random.default_rng(seed)
    templates = _templates()
    vocab = {g: i for i, g in enumerate(sorted(set().union(*(t for _, t in templates))))}
    filler = sorted({w for p in background for w in p.split()}, key=_by_hash)[:FILLER]
    made = [(v, FAMILIES.index(f), k) for f, ts in sorted(TEMPLATES.items()) for k, t in enumerate(ts) for v in _variants(t, rng, filler)]
    rows, nth = [r[:2] for r in made], [r[2] for r in made]
    names = [t for f, t in templates]
    for p in background:
        own = set(grams(tokens(p)))
        if not any(len(own & t) >= LEAST_MATCH * len(t) for t in names):
            rows.append((p, len(FAMILIES) - 1))
    rows += [(w, len(FAMILIES) - 1) for w in ("license", "the version 2.0 of", "all rights", "free of charge", "under the terms of the", "permission to use", "public version", "")]
    x = np.zeros((len(rows), len(vocab)), np.float32)
    y = np.array([r[1] for r in rows])
    for i, (t, _) in enumerate(rows):
        at = [vocab[g] for g in set(grams(tokens(t))) if g in vocab]
        if at:
            x[i, at] = 1 / math.sqrt(len(at))
    weight = 1.0 / np.bincount(y, minlength=len(FAMILIES)).clip(1)[y]
    weight[y == len(FAMILIES) - 1] *= 3
    test = rng.random(len(rows)) < 0.2
    test[: len(nth)] = np.array(nth) == 1  # each family's second template

    def probs(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def learnt(own):
        w, b = np.zeros((len(vocab), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        xs, ws, hot = x[own], (weight[own] / weight[own].sum()).astype(np.float32)[:, None], np.eye(len(FAMILIES), dtype=np.float32)[y[own]]
        mw, vw, mb, vb = 0.0, 0.0, 0.0, 0.0
        for t in range(1, epochs + 1):
            g = (probs(xs @ w + b) - hot) * ws
            gw, gb = xs.T @ g, g.sum(0)
            mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            fix = math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w = w - 0.1 * rate * (fix * mw / (np.sqrt(vw) + 1e-6) + decay * w)
            b = b - 0.1 * rate * fix * mb / (np.sqrt(vb) + 1e-6)
        return w, b

    w, b = learnt(~test)
    z = x[test] @ w + b
    nll = lambda h: -np.log(probs(z / h)[np.arange(int(test.sum())), y[test]] + 1e-12).mean()
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=nll)
    w, b = learnt(np.ones(len(rows), bool))
    weights = {g: tuple(float(v) for v in w[i]) for g, i in vocab.items()}
    return Model(weights, tuple(float(v) for v in b), heat, templates)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = MAX_TRAIN, max_paragraphs: int = PARAGRAPHS) -> Model:
    """Fit with the paragraphs of at most about ``max_docs`` different documents, chosen by hash of key and text.

    Of their different paragraphs ``max_paragraphs`` stay, by hash of the paragraph.  Copies of a row count once, whatever their
    number; texts above ``MAX_TEXT`` bytes are left out.
    """
    own = C.pick(docs, key, text).where(F.octet_length(text) <= MAX_TEXT).withColumn("h", F.xxhash64(key, text))
    n = own.select("h").distinct().count()
    if n > max_docs:
        own = own.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(max_docs / n * (1 << 20)) + 1)
    texts = sorted(own.groupBy("h").agg(F.min(text).alias("t")).select("t").toArrow()["t"].to_pylist())
    known = Templates(_templates())
    parts = sorted({p for t in texts for p in _clean(t, known)}, key=_by_hash)
    return fit(parts[:max_paragraphs])


def scan(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep, matches``: every line or run of wrapped lines with a confirmed family, as character spans with probability and match.

    Null and empty texts have no match.  One row for each input row; whole texts are read.
    """
    weights, bias, heat, templates = model.weights, model.bias, model.heat, model.templates

    def fn(texts: list[bytes]) -> list:
        own = Model(weights, bias, heat, templates)
        out = []
        for raw in texts:
            found = own.find(raw.decode("utf-8", "replace"))
            out.append([{"family": f, "start": a, "end": b, "p": p, "match": match} for f, a, b, p, match in found])
        return [out]

    return C.map_texts(docs, keep, [("matches", "array<struct<family:string,start:int,end:int,p:double,match:double>>")], fn, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    names = F.array_join(F.sort_array(F.array_distinct("matches.family")), ",")
    return found.select("doc_id", names.alias("families"), F.size("matches").alias("n_matches"), F.round(F.coalesce(F.array_max("matches.p"), F.lit(0.0)), 4).alias("score"))
