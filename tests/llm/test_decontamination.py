from __future__ import annotations

import hashlib
import random
import re

import pytest

from lattica.llm import decontamination as D

from .conftest import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def windows(items, k):
    out = {}
    for i, t in items:
        w = split(t)
        for at in range(max(1, len(w) - k + 1) if w else 0):
            out.setdefault(tuple(w[at : at + k]), set()).add(str(i))
    return out


def brute(docs, items, k, least):
    found, known = [], windows(items, k)
    for d, t in docs:
        w, hit, of = split(t), set(), set()
        for n in {len(x) for x in known}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in known:
                    hit.update(range(at, at + n))
                    of |= known[tuple(w[at : at + n])]
        found.append((d, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), len(of) >= least))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.choice([0, 1, 3, 7, 8, 9, 30]), 60))) for i in range(14)] + [(14, None), (15, "ÉTÉ is, not été-lower"), (16, "the the the the the the the the the"), (1, "repeated row of item one")]
    docs = []
    for d in range(50):
        w = words(rng, rng.randint(0, 200), 60)
        for i in rng.sample(range(14), rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = (items[i][1] or "").upper().split()
        docs.append((d, "; ".join(w)))
    docs += [(50, None), (51, ""), (52, "ÉTÉ IS NOT été lower"), (53, "été is not été lower"), (54, "the " * 30), (55, "-- 12 --"), (3, docs[3][1]), (4, "another text of document four"), (None, docs[5][1])]
    extra = [(d, t, "x", 1) for d, t in docs]
    return spark.createDataFrame(extra, "doc_id bigint, text string, term string, pos int").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), docs, items


@pytest.mark.parametrize(("k", "bound"), [(8, 500_000), (3, 500_000), (8, 0)])
def test_against_brute_force(tables, k, bound, monkeypatch):
    docs, items, doc_rows, item_rows = tables
    if not bound:
        monkeypatch.setattr(D, "_is_small", lambda df, rows: False)  # shuffled joins in place of broadcasts
    got = D.decontaminate(docs, items, k=k).drop("item_ids").collect()
    assert sorted(map(tuple, got), key=repr) == brute(doc_rows, item_rows, k, 2)


def test_main_path_runs_no_python(tables):
    docs, items, *_ = tables
    plan = D.decontaminate(docs, items).explain
    index = D.PositionalIndex(docs, items, 8)
    text = index.matches()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
    assert "CartesianProduct" not in text
    assert plan


def test_long_documents_beyond_the_broadcast_bound(spark):
    """Tokens travel without their texts: a document of n words shuffles a few bytes a word, not n words a word."""
    rng = random.Random(4)
    text = " ".join(words(rng, 60_000, 300))
    items = [(i, " ".join(text.split()[at : at + 12])) for i, at in enumerate((0, 777, 30_000, 59_988))]
    docs = spark.createDataFrame([(1, text), (2, text[:90_000])], "doc_id bigint, text string")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.PositionalIndex(docs, tests, 8, broadcast_rows=0).matches().collect()
    assert {(r["doc"], r["wid"], r["start"]) for r in got} == {(r["doc"], r["wid"], r["start"]) for r in D.PositionalIndex(docs, tests, 8).matches().collect()}
    assert {r["start"] for r in got if r["doc"] == 1} >= {1, 5, 778, 30_001, 59_989, 59_993}


def test_proximity_takes_gaps(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "aa xx bb cc dd"), (3, "aa xx yy zz bb cc dd")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "aa bb cc dd")], "item_id bigint, text string")
    exact = {r["doc"] for r in D.PositionalIndex(docs, items, 4).matches().collect()}
    near = {r["doc"] for r in D.PositionalIndex(docs, items, 4, slop=1).matches().collect()}
    assert (exact, near) == ({1}, {1, 2})


def test_dropping(tables):
    docs, items, doc_rows, item_rows = tables
    bad = {d for d, *_, n, _, _ in brute(doc_rows, item_rows, 8, 1) if n}
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {d for d, _ in doc_rows} - bad
    assert len(kept.collect()) == sum(not n for *_, n, _, _ in brute(doc_rows, item_rows, 8, 1))


def test_nothing(tables, nothing):
    docs, items, doc_rows, _ = tables
    assert D.decontaminate(nothing, items).collect() == []
    clean = D.decontaminate(docs, items.where("false")).collect()
    assert len(clean) == len(doc_rows)
    assert {r["n_hit"] for r in clean} == {0}
