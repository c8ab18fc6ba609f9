"""Toxicity, language identification, n-gram scores: held-out accuracy, gradients, and a plain model."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import language_id as L
from lattica.llm import lm_scoring as M
from lattica.llm import toxicity as X

from .conftest import words


def bag(rng, toxic):
    lines = [" ".join(words(rng, rng.randint(3, 15), 200)) for _ in range(rng.randint(1, 12))]
    if toxic:
        lines[rng.randrange(len(lines))] += " " + rng.choice(["grumble", "grumbling", "snarl"])
    return ". ".join(lines)


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(1)
    data = [(bag(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    return X.train([t for t, _ in data], [y for _, y in data])


def test_toxicity_on_held_out_documents(toxic_model):
    rng = random.Random(2)
    data = [(bag(rng, i % 5 == 0), i % 5 == 0) for i in range(300)]
    right = sum((toxic_model.score(t)[0] >= 0.7) == y for t, y in data)
    assert right >= 0.97 * len(data)


def test_toxicity_locates_the_sentence(toxic_model):
    text = "waa wab wac. wad wae grumble waf. wag wah"
    score, a, b, worst = toxic_model.score(text)
    assert "grumble" in text[a:b]
    assert 0 < worst <= score <= 1
    assert [text[a:b] for a, b, _ in toxic_model.offending(text)] == [" wad wae grumble waf"]
    # noisy-or
    _, z = toxic_model.sentence_logits(text)
    assert math.isclose(score, 1 - np.prod(1 - 1 / (1 + np.exp(-z))), rel_tol=1e-9)
    assert toxic_model.score(None) == toxic_model.score("...") == (0.0, None, None, None)
    # the last of many sentences counts, and a long one is cut into runs
    assert toxic_model.score("waa wab. " * 5000 + "snarl")[0] >= 0.7
    assert toxic_model.score("waa " * 5000 + "snarl")[0] >= 0.7


def test_sentences_keep_their_places():
    text = "İİİİ ok. bad x."
    assert [(text[a:b], ws) for a, b, ws in X.sentences(text)] == [("İİİİ ok", ["ok", "İİİİ"]), (" bad x", ["bad", "x"])]


def test_training_samples_are_bounded(spark):
    """A repeated id counts once, whatever its rows."""
    docs = spark.createDataFrame([(i % 3, f"text {i % 7} of it", "aa" if i % 3 else "bb", 1.0, "x") for i in range(300)], "doc_id bigint, text string, lang string, score double, lang_pred string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 0)], "doc_id bigint, toxic int")
    texts, y = X.training_sample(docs, labels, F.lit(True))
    assert (len(texts), sorted(y)) == (3, [0, 0, 1])
    texts, langs = L.training_sample(docs, F.lit(True))
    assert (len(texts), sorted(langs)) == (3, ["aa", "aa", "bb"])
    model = L.fit(docs, F.lit(True))
    assert L.identify(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert L.identify(docs, model, keep={"aa"}, least=1.01).count() == 0
    assert X.score_texts(docs, X.fit(docs, labels, F.lit(True))).columns[:4] == ["doc_id", "text", "lang", "lang_pred"]


def test_toxicity_tables(spark, documents, nothing, toxic_model):
    out = X.score_texts(documents.select("doc_id", "text"), toxic_model)
    assert out.count() == documents.count()
    assert out.where("score is null or score < 0 or score > 1").isEmpty()
    kept = X.score_texts(documents, toxic_model, keep=0.7)
    assert kept.columns == documents.columns
    assert kept.count() == out.where("score < 0.7").count()
    assert X.score_texts(nothing, toxic_model, keep=0.7).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (9, 7)], "doc_id bigint, toxic int")
    texts, ys = X.training_sample(documents, labels, F.col("doc_id") != 5)
    assert sorted(ys) == [0, 1]
    model = X.fit(nothing.select("doc_id", "text"), labels, F.lit(True))
    assert model.score("anything")[0] < 0.01


def speech(rng, lang):
    parts = {"xx": "ka ki ko mu na", "yy": "ere ost ing the", "zz": "ção ñe é lla ß"}[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60)))


@pytest.fixture(scope="module")
def language_model():
    rng = random.Random(3)
    data = [(speech(rng, lang).encode(), lang) for lang in ("xx", "yy", "zz") for _ in range(40)]
    return L.train([t for t, _ in data], [y for _, y in data], width=6, span=32, batch=96, steps=120)


def test_language_on_held_out_documents(language_model):
    rng = random.Random(4)
    data = [(speech(rng, lang), lang) for lang in ("xx", "yy", "zz") for _ in range(40)]
    got = language_model.predict([t for t, _ in data])
    assert sum(g == y for (g, _), (_, y) in zip(got, data, strict=True)) >= 0.97 * len(data)
    assert language_model.predict([None, "", "12 !"]) == [("und", 0.0)] * 3


def test_language_pools_every_position(language_model):
    text = ("ka muki " * 100 + "ereost the " * 60).encode()
    p = language_model.position_probabilities(text)
    assert p.shape == (len(text), 3)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(p.mean(axis=0), language_model.document_probabilities([text])[0], atol=1e-5)
    labels = language_model.label_positions(text)
    assert (labels[200], labels[-200]) == ("xx", "yy")
    alone = language_model.document_probabilities([b"muka"])[0]
    assert np.allclose(alone, language_model.document_probabilities([text, b"muka", b"x" * 5000])[1], atol=1e-5)


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    gru = L.ByteGru(rng.standard_normal((9, 256)).astype(np.float64), rng.standard_normal((9, 3)).astype(np.float64))
    codes = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    weights = rng.standard_normal((7, 3, 5))
    states = gru.run(codes).astype(np.float64)
    g_byte, g_state = gru.gradients(codes, states, weights)

    def loss():
        return float((gru.run(codes).astype(np.float64) * weights).sum())

    for i, j in [(0, 1), (4, 2), (8, 0)]:
        gru.of_state[i, j] += 1e-3
        up = loss()
        gru.of_state[i, j] -= 2e-3
        down = loss()
        gru.of_state[i, j] += 1e-3
        assert np.isclose(g_state[i, j], (up - down) / 2e-3, rtol=0.02, atol=0.01)
    c = codes[3, 2]
    gru.of_byte[5, c] += 1e-3
    up = loss()
    gru.of_byte[5, c] -= 2e-3
    assert np.isclose(g_byte[5, c], (up - loss()) / 2e-3, rtol=0.02, atol=0.01)


def test_language_tables(documents, nothing, language_model):
    out = L.identify(documents.select("doc_id", "text"), language_model)
    assert out.count() == documents.count()
    assert {r["lang_pred"] for r in out.where("doc_id between 77 and 80").collect()} == {"und"}
    kept = L.identify(documents, language_model, keep={"xx", "yy", "zz"})
    assert kept.columns == documents.columns
    assert kept.count() == documents.count() - 4
    assert L.identify(nothing, language_model).collect() == []
    texts, langs = L.training_sample(documents, F.col("doc_id") % 2 == 0, per_language=5)
    assert set(langs) == {"en"}
    assert 0 < len(texts) <= 5
    assert L.fit(nothing, F.lit(True)).predict(["abc"]) == [("und", 0.0)]


def plain_scores(rows, learn, min_count=1):
    """The model in dictionaries."""
    tokens = [(i, [*(w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w), ""]) for i, t in rows]
    grams = [Counter(g for i, ws in tokens if learn(i) for g in zip(*(["", "", *ws][2 - o + j : len(ws) + 2 - o + j] for j in range(o + 1)), strict=True)) for o in range(3)]
    n, v = sum(grams[0].values()), len(grams[0])
    base = lambda w: (grams[0][w,] + 0.5) / (n + 0.5 * (v + 1))
    q, back = {}, Counter()
    for c in grams[1:]:
        context = Counter()
        for g, k in c.items():
            context[g[:-1]] += k
        for g, k in c.items():
            if k >= min_count:
                q[g] = (k - 0.75) / context[g[:-1]]
                back[g[:-1]] += q[g]

    def p(g):
        return base(*g) if len(g) == 1 else q.get(g, 0) + (1 - back[g[:-1]]) * p(g[1:])

    out = []
    for i, ws in tokens:
        whole = sum(math.log10(p(g)) for g in zip(["", "", *ws], ["", *ws], ws, strict=False))
        out.append((i, len(ws), sum(grams[0][w,] > 0 for w in ws), n, sum(math.log10(base(w)) for w in ws), whole))
    return sorted(out)


@pytest.mark.parametrize(("block", "entries", "hot", "least"), [(8 << 20, 1_500_000, 2_000_000, 1), (8 << 20, 1_500_000, 2_000_000, 2), (400, 60, 20, 1), (3000, 500, 4, 1), (400, 60, 20, 2)])
def test_scores_equal_a_plain_model(documents, block, entries, hot, least):
    """Also with many blocks, shards and parts of frequent words and pairs."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(map(tuple, M.score_documents(documents, F.col("doc_id") % 5 != 1, min_count=least, block_bytes=block, shard_entries=entries, hot=hot).collect()))
    expected = plain_scores(rows, lambda i: i % 5 != 1, least)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4] for g in got], [e[4] for e in expected], rtol=1e-9)
    # a byte a probability and a backoff: each within 4 % or so
    assert all(abs(g[5] - e[5]) <= 0.02 * g[1] + 0.005 * abs(e[5]) for g, e in zip(got, expected, strict=True))


def test_scores_without_training_or_rows(documents, nothing):
    alone = M.score_documents(documents, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in alone} == {(0, 0, 0.0, 0.0)}
    assert M.score_documents(nothing, F.lit(True)).collect() == []


@pytest.mark.parametrize(("n", "span"), [(0, 10), (1, 1), (5, 50), (1000, 10_000), (1000, 200), (3000, 1 << 45), (70, 70)])
def test_elias_fano(n, span):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, span, n))
    ef = M.EliasFano(x)
    assert ef.values().tolist() == x.tolist()
    asked = np.unique(np.concatenate([x, x + 1, np.maximum(x - 1, 0), [0, span, 2 * span]]))
    place, equal = ef.find(asked)
    assert place.tolist() == np.searchsorted(x, asked).tolist()
    assert equal.tolist() == np.isin(asked, x).tolist()
    if (n, span) == (1000, 10_000):
        assert (ef.high.nbytes + ef.low.nbytes) * 8 < 7 * n


def test_trie_lookup():
    rng = np.random.default_rng(7)
    triples = np.unique(rng.integers(1, 30, (2500, 3)), axis=0)
    triples = triples[triples[:, 0] % 3 > 0]
    pairs, pair = np.unique(triples[:, :2], axis=0, return_inverse=True)
    count = rng.integers(1, 9, len(triples))
    trie, context, of_word = M.build_part(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), bool), pair, triples[:, 2], count, 1)
    assert context.tolist() == np.bincount(pair, count).tolist()
    grid = np.array([(a, b, c) for a in range(32) for b in range(32) for c in range(0, 32, 3)])
    words = np.unique(grid[:, 0])
    asked, of = np.unique(grid[:, :2], axis=0, return_inverse=True)
    one, two, back, three = trie.answer(words, np.searchsorted(words, asked[:, 0]), asked[:, 1], of, grid[:, 2])
    own = {tuple(p): n for p, n in zip(pairs.tolist(), context, strict=True)}
    first = Counter()
    for (a, _), n in own.items():
        first[a] += n
    seen = {tuple(t): n for t, n in zip(triples.tolist(), count.tolist(), strict=True)}
    assert three.tolist() == [int(M.quantise(np.array([(seen[g] - 0.75) / own[g[:2]]]))[0]) if g in seen else 0 for g in map(tuple, grid.tolist())]
    assert two.tolist() == [int(M.quantise(np.array([(own[p] - 0.75) / first[p[0]]]))[0]) if p in own else 0 for p in map(tuple, asked.tolist())]
    assert [x == 255 for x in back] == [p not in own for p in map(tuple, asked.tolist())]
    assert [x == 255 for x in one] == [w not in first for w in words.tolist()]
    assert (M.quantise(M.VALUES[1:]) == np.arange(1, 256)).all()
    assert (M.quantise_backoff(M.BACKOFFS) == np.arange(256)).all()
