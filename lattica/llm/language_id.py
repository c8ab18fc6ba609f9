"""Language identification by a bidirectional gated recurrent network over bytes.

One GRU reads a window of bytes forwards and one backwards; a softmax over both states labels every byte, and a
document's probabilities are the mean of its bytes' probabilities. Trained in numpy by backpropagation through time.

A text is read whole, in windows of WINDOW bytes, each with CONTEXT bytes on both sides that only warm up the states;
every byte is labelled once, memory is bounded whatever the length, and all windows of a batch step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import batches, narrow

WINDOW, CONTEXT, PAD = 256, 16, 10
_TOGETHER = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


@dataclass
class ByteGru:
    """One direction: input gates of each byte (3h x 256) and state weights (3h x h); gates in the order update, reset, new."""

    of_byte: np.ndarray
    of_state: np.ndarray

    @property
    def width(self) -> int:
        return self.of_state.shape[1]

    def run(self, codes: np.ndarray) -> np.ndarray:
        """States (steps x h x windows) after each step of codes (steps x windows)."""
        h, (steps, n) = self.width, codes.shape
        out = np.empty((steps, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        for t in range(steps):
            gates = self.of_byte.take(codes[t], axis=1)
            own = self.of_state @ state
            zr = _sigmoid(np.add(gates[: 2 * h], own[: 2 * h], out=gates[: 2 * h]))
            new = gates[2 * h :]
            new += np.multiply(zr[h:], own[2 * h :], out=own[2 * h :])
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=out[t])
            state *= zr[:h]
            state += new
        return out

    def gradients(self, codes: np.ndarray, states: np.ndarray, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of the two weights, given those of all states."""
        h, (steps, n) = self.width, codes.shape
        g_byte, g_state = np.zeros_like(self.of_byte), np.zeros_like(self.of_state)
        flow = np.zeros((h, n), np.float32)
        for t in reversed(range(steps)):
            before = states[t - 1] if t else np.zeros((h, n), np.float32)
            gates, own = self.of_byte.take(codes[t], axis=1), self.of_state @ before
            zr = _sigmoid(gates[: 2 * h] + own[: 2 * h])
            z, r = zr[:h], zr[h:]
            new = np.tanh(gates[2 * h :] + r * own[2 * h :])
            flow = flow + upstream[t]
            d_new = flow * (1 - z) * (1 - new * new)
            d_z = flow * (before - new) * z * (1 - z)
            d_r = d_new * own[2 * h :] * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new])
            d_own = np.concatenate([d_z, d_r, d_new * r])
            for k in range(3 * h):
                g_byte[k] += np.bincount(codes[t], d_in[k], 256)
            g_state += d_own @ before.T
            flow = flow * z + self.of_state.T @ d_own
        return g_byte, g_state


@dataclass
class LanguageModel:
    """The two directions, the output layer (languages x 2h, languages) and the languages' names."""

    forward: ByteGru
    backward: ByteGru
    out: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def logits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits (steps x languages x windows) and both directions' states."""
        f = self.forward.run(codes)
        b = self.backward.run(codes[::-1])[::-1]
        h = self.forward.width
        return np.matmul(self.out[:, :h], f) + np.matmul(self.out[:, h:], b) + self.bias[:, None], f, b

    def position_probabilities(self, raw: bytes) -> np.ndarray:
        """Probabilities (bytes x languages) of every position of a text."""
        return np.concatenate([p for _, p in self._labelled([raw])]) if raw else np.zeros((0, len(self.languages)))

    def label_positions(self, raw: bytes) -> list[str]:
        return [self.languages[i] for i in self.position_probabilities(raw).argmax(axis=1)]

    def _windows(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, owners, lengths) of up to _TOGETHER windows at a time."""
        codes, owner, length = [], [], []
        for i, raw in enumerate(texts):
            n = len(raw)
            count = -(-n // WINDOW)
            line = np.full(CONTEXT + count * WINDOW + CONTEXT, PAD, np.uint8)
            line[CONTEXT : CONTEXT + n] = np.frombuffer(raw, np.uint8)
            view = np.lib.stride_tricks.sliding_window_view(line, WINDOW + 2 * CONTEXT)[::WINDOW]
            for at in range(0, count, _TOGETHER):
                part = view[at : at + _TOGETHER]
                codes.append(part)
                owner.append(np.full(len(part), i))
                length.append(np.minimum(WINDOW, n - WINDOW * np.arange(at, at + len(part))))
                if sum(map(len, codes)) >= _TOGETHER:
                    yield np.concatenate(codes).T, np.concatenate(owner), np.concatenate(length)
                    codes, owner, length = [], [], []
        if codes:
            yield np.concatenate(codes).T, np.concatenate(owner), np.concatenate(length)

    def _labelled(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        for codes, owner, length in self._windows(texts):
            p = self._softmax(self.logits(np.ascontiguousarray(codes))[0])
            for w, n in enumerate(length):
                yield owner[w], p[CONTEXT : CONTEXT + n, :, w]

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the positions' probabilities (texts x languages); an empty text has zeros."""
        total = np.zeros((len(texts), len(self.languages)))
        place = np.arange(WINDOW)[:, None, None]
        for codes, owner, length in self._windows(texts):
            x, _, _ = self.logits(np.ascontiguousarray(codes))
            p = self._softmax(x[CONTEXT : CONTEXT + WINDOW])
            if (length < WINDOW).any():
                p *= place < length
            sums = p.sum(axis=0, dtype=np.float64)
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(owner, sums[k], len(texts))
        return total / np.maximum(1, [len(t) for t in texts])[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; und and 0 without a letter."""
        real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if self.languages and real:
            p = self.document_probabilities([texts[i].encode() for i in real])
            for i, row in zip(real, p, strict=True):
                best = int(row.argmax())
                out[i] = (self.languages[best], float(min(1.0, row[best])))
        return out


def train(texts: list[bytes], labels: list[str], width: int = 8, span: int = 64, batch: int = 256, steps: int = 220, rate: float = 0.02, seed: int = 7) -> LanguageModel:
    """Fit by Adam on windows drawn evenly from the languages and anywhere in their texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    by = [[t for t, x in zip(texts, labels, strict=True) if x == lang and t] for lang in languages]

    def gru() -> ByteGru:
        return ByteGru((0.3 * rng.standard_normal((3 * width, 256))).astype(np.float32), (0.3 * rng.standard_normal((3 * width, width))).astype(np.float32))

    model = LanguageModel(gru(), gru(), (0.3 * rng.standard_normal((len(languages), 2 * width))).astype(np.float32), np.zeros(len(languages), np.float32), languages)
    if len(languages) < 2 or not all(by):
        return model
    params = [model.forward.of_byte, model.forward.of_state, model.backward.of_byte, model.backward.of_state, model.out, model.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=batch)
        codes = np.full((span, batch), PAD, np.uint8)
        for w, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(max(1, len(t) - span + 1))
            part = np.frombuffer(t[at : at + span], np.uint8)
            codes[: len(part), w] = part
        x, f, b = model.logits(codes)
        p = model._softmax(x)
        p[:, y, np.arange(batch)] -= 1
        p /= span * batch
        h = width
        up_f, up_b = np.matmul(model.out[:, :h].T, p), np.matmul(model.out[:, h:].T, p)
        g_out = np.concatenate([np.einsum("tkn,thn->kh", p, s) for s in (f, b)], axis=1)
        grads = [*model.forward.gradients(codes, f, up_f), *model.backward.gradients(codes[::-1], b[::-1], up_b[::-1]), g_out, p.sum(axis=(0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def training_sample(docs: DataFrame, learnable: Column, per_language: int = 150, most_chars: int = 8_000) -> tuple[list[bytes], list[str]]:
    """Texts and languages of a bounded sample: per language so many documents with a letter, chosen by a hash of their id;
    of a repeated id the least language and text are taken."""
    good = learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= most_chars)
    known = docs.where(good).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # a bound on the hash for each language leaves about four times the texts wanted, so no task sees a language whole
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return [], []
    spans = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], float(1 << 64) * min(1.0, 4.0 * per_language / r["n"]))))
    thin = known.where(F.col("h").cast("double") + float(1 << 63) <= spans[F.col("lang")])
    chosen = {}
    for lang, doc, h in thin.select("lang", "doc_id", "h").distinct().collect():  # about 4 * per_language rows a language
        chosen.setdefault(lang, []).append((h, doc))
    ids = sorted({doc for found in chosen.values() for _, doc in sorted(found)[:per_language]})
    own = docs.where(good & F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("t"))
    rows = sorted(own.select("doc_id", "t.lang", "t.text").collect()) if ids else []
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, learnable: Column, **bounds: int) -> LanguageModel:
    """A model of the languages that the learnable rows (a condition on doc_id) name."""
    return train(*training_sample(docs, learnable, **bounds))


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score"), keep: set[str] | None = None, least: float = 0.0, text: str = "text") -> DataFrame:
    """docs with the predicted language and its probability or, if keep is given, docs as they are without those of other
    languages or a probability under least.

    A null text or one without a letter is und, at score 0. Columns of docs that are called like the new ones are replaced.
    Every row is labelled on its own whole text; no shuffle.
    """
    docs = docs if keep is not None else docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    schema = docs.schema if keep is not None else T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(it, 1 << 21):
            out = model.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            if keep is not None:
                yield batch.filter(pa.array([lang in keep and p >= least for lang, p in out]))
                continue
            new = [pa.array([lang for lang, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return narrow(docs).mapInArrow(run, schema)
