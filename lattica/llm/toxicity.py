"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its words and word beginnings; the document's
score is their noisy-or, 1 - prod(1 - p). Only documents carry labels: the sentence scorer is trained through the
noisy-or, and so learns which sentences make a document toxic, and the same scores then locate them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import batches, narrow

_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Sentences of more words are scored in runs of this many.
_LONGEST = 40
_BEGINNINGS = (3, 4, 5, 6, 7)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, different words in lower case) of each sentence of the text; sentences without a word are left out."""
    at, low = 0, text.lower()
    if len(low) != len(text):  # a letter that grows keeps its case, so that places are the text's
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for m in [*_END.finditer(low), None]:
        end = m.start() if m else len(low)
        words = _WORD.findall(low, at, end)
        if len(words) <= _LONGEST:
            if words:
                yield at, end, sorted(set(words))
        else:
            found = list(_WORD.finditer(low, at, end))
            for i in range(0, len(found), _LONGEST):
                part = found[i : i + _LONGEST]
                yield part[0].start(), part[-1].end(), sorted(set(words[i : i + _LONGEST]))
        at = m.end() if m else end


def features(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [word, *("^" + word[:n] for n in _BEGINNINGS if len(word) > n)]


@dataclass
class ToxicityModel:
    """Weights of features, the bias of a sentence, and what the training saw."""

    weights: dict[str, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def _value(self, word: str) -> float:
        if len(self.cache) > 100_000:
            self.cache.clear()
        w = self.weights
        v = self.cache[word] = sum(w.get(f, 0.0) for f in features(word))
        return v

    def sentence_logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, logits = [], []
        get = self.cache.__getitem__
        for a, b, words in sentences(text):
            try:
                z = sum(map(get, words))
            except KeyError:
                z = sum(self.cache[w] if w in self.cache else self._value(w) for w in words)
            spans.append((a, b))
            logits.append(z + self.bias)
        return spans, np.array(logits)

    def score(self, text: str | None) -> tuple[float, int | None, int | None, float | None]:
        """The document's score, and its worst sentence's start, end and score; a text without words scores 0."""
        spans, z = self.sentence_logits(text or "")
        if not len(z):
            return 0.0, None, None, None
        clean = -np.logaddexp(0, z)  # log(1 - p)
        worst = int(z.argmax())
        return float(-np.expm1(clean.sum())), *spans[worst], float(-np.expm1(clean[worst]))

    def offending(self, text: str, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence that scores threshold or more."""
        spans, z = self.sentence_logits(text)
        p = -np.expm1(-np.logaddexp(0, z))
        return [(*s, float(x)) for s, x in zip(spans, p, strict=True) if x >= threshold]


def train(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.1, decay: float = 1e-5, least_docs: int = 5, least_z: float = 4.0) -> ToxicityModel:
    """Fit by full-batch Adam on the noisy-or likelihood.

    Only features of least_docs documents or more whose share among toxic documents is greater by least_z standard errors
    get a weight: rare words of a few documents say nothing about others. Weights are not negative, so that no clean word
    excuses a toxic one.
    """
    types: dict[str, int] = {}
    words, ends, owner = [], [], []
    df: tuple[Counter, Counter] = (Counter(), Counter())
    for d, text in enumerate(texts):
        seen: set[str] = set()
        for _, _, ws in sentences(text):
            words += [types.setdefault(w, len(types)) for w in ws]
            ends.append(len(words))
            owner.append(d)
            seen.update(ws)
        df[labels[d]].update({f for w in seen for f in features(w)})
    if not words or len(set(labels)) < 2:
        return ToxicityModel({}, 12.0 if labels and min(labels) else -12.0)
    n1 = sum(labels)
    n0 = len(labels) - n1

    def telling(f: str) -> bool:
        a, c = df[1][f], df[0][f]
        both = (a + c) / (n1 + n0)
        spread = np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
        return a + c >= least_docs and spread > 0 and a / n1 - c / n0 >= least_z * spread

    ids = {f: i for i, f in enumerate(sorted(filter(telling, df[0].keys() | df[1].keys())))}
    of_type = [[ids[f] for f in features(w) if f in ids] for w in types]
    type_of = np.repeat(np.arange(len(types)), [len(x) for x in of_type])
    feature_of = np.array([f for x in of_type for f in x], np.int64)
    words_, starts, owner_ = np.array(words), np.array([0, *ends[:-1]]), np.array(owner)
    sentence_of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    y = np.array(labels, float)
    w, b = np.zeros(len(ids)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        by_type = np.bincount(type_of, w[feature_of], len(types))
        z = np.add.reduceat(by_type[words_], starts) + b
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(owner_, -np.logaddexp(0, z), len(y))
        whole = -np.expm1(clean)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        g = p * np.where(y > 0, -np.exp(clean) / np.maximum(whole, 1e-12), 1.0)[owner_] / len(y)
        by_type = np.bincount(words_, g[sentence_of], len(types))
        gw = np.bincount(feature_of, by_type[type_of], len(ids)) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w = np.maximum(0, w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8))
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return ToxicityModel({f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}, float(b))


def training_sample(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", most_toxic: int = 1500, most_clean: int = 4000, most_chars: int = 20_000) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample of labelled documents, chosen by a hash of their id; learnable sees doc_id.

    A document with several labels counts as toxic if one of them says so; of a repeated id the least text is taken. Longer
    texts are not sampled.
    """
    known = labels.where(learnable).groupBy("doc_id").agg(F.max(label).alias("y")).where("y in (0, 1)")
    fits = docs.where(F.length("text").between(1, most_chars)).select("doc_id").distinct()
    pool = known.join(fits, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    few = [pool.where(F.col("y") == y).orderBy("h", "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    chosen = few[0].unionAll(few[1]).select("doc_id", "y", "h")  # at most most_toxic + most_clean rows
    own = docs.where(F.length("text").between(1, most_chars)).join(F.broadcast(chosen), "doc_id")
    rows = own.groupBy("doc_id", "h", "y").agg(F.min("text").alias("text")).select("h", "text", "y").collect()
    rows.sort()
    return [r["text"] for r in rows], [r["y"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, **bounds: int) -> ToxicityModel:
    return train(*training_sample(docs, labels, learnable, **bounds))


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("worst_start", T.IntegerType()), T.StructField("worst_end", T.IntegerType()), T.StructField("worst_score", T.DoubleType())])


def score_texts(docs: DataFrame, model: ToxicityModel, names: tuple[str, str, str, str] = ("score", "worst_start", "worst_end", "worst_score"), keep: float | None = None, text: str = "text") -> DataFrame:
    """docs with the score and the worst sentence, or, if keep is given, docs as they are without those that score keep or more.

    A null, empty or wordless text scores 0. Columns of docs that are called like the new ones are replaced. Every row is
    scored on its own whole text; no shuffle.
    """
    docs = docs if keep is not None else docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = docs.schema if keep is not None else T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, SCORED.fields, strict=True))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(it, 1 << 23):
            out = [model.score(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            if keep is not None:
                yield batch.filter(pa.array([s[0] < keep for s in out]))
                continue
            new = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.float64(), pa.int32(), pa.int32(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return narrow(docs).mapInArrow(run, schema)
