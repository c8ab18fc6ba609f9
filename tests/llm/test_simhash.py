from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash as S
from lattica.llm.components import connected_components


def classes(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)), {g for g in grams}


def test_fingerprint_is_spark_xxhash(spark):
    text = "Alpha beta  gamma\tDELTA é"
    h = spark.sql("select xxhash64('alpha beta gamma') h").first()["h"] & (2**64 - 1)
    assert h == xxhash.xxh64_intdigest(b"alpha beta gamma", 42)
    assert S.fingerprint(S.shingles(text.encode(), 3)) == plain_fingerprint(text, 3)[0]
    assert S.fingerprint(S.shingles(None, 3)) == 0
    assert S.shingles(b"one two", 3) == [b"one two"]


def test_near_duplicates_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    prints = {(i, t): plain_fingerprint(t, 3)[0] for i, t in rows}
    fps = sorted(set(prints.values()))
    label = classes(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    least = defaultdict(lambda: 1 << 60)
    for (i, _), p in prints.items():
        least[label[p]] = min(least[label[p]], i)
    expected = sorted((i, f"{prints[i, t]:016x}", least[label[prints[i, t]]]) for i, t in rows)
    assert sorted(map(tuple, S.near_duplicates(documents, k=3, bits=2).collect())) == expected


@pytest.mark.parametrize(("bits", "bucket_rows", "seed"), [(2, 2048, 1), (2, 4, 2), (3, 8, 3), (1, 3, 4)])
def test_links_lose_nothing(spark, bits, bucket_rows, seed):
    """Dense clusters, biased bits and small buckets: classes equal those of all pairs."""
    rng = random.Random(seed)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64) & rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits + 1))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = S.near_links(prints, bits, bucket_rows=bucket_rows).collect()
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= bits for r in got)
    assert classes(signed, [(r["a"], r["b"]) for r in got]) == classes(signed, pairs)


def test_links_of_buckets_beside_full_ones(spark):
    """Rows lie in many partitions and full buckets are taken out by a join: the others' rows must still meet in one task."""
    rng = np.random.default_rng(3)
    centre, size = rng.integers(0, 1 << 63, 1, np.uint64)[0], 3000
    crowd = np.full(size, centre)
    for _ in range(3):
        crowd ^= np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)
    lone = rng.integers(0, 1 << 63, 2000, np.uint64)
    fps = np.unique(np.concatenate([crowd, lone, lone ^ (np.uint64(1) << rng.integers(0, 63, len(lone)).astype(np.uint64))]))
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 2, 1))
    signed = fps.view(np.int64).tolist()
    prints = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(16, "fp")
    many = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in many}
    try:
        for c, v in many.items():
            spark.conf.set(c, v)
        got = S.near_links(prints, 2, bucket_rows=64).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert classes(signed, [(r["a"], r["b"]) for r in got]) == classes(signed, [(signed[x], signed[y]) for x, y in zip(a, b, strict=True)])


def test_thresholds_keep_the_pigeonhole_sum_and_cost_least():
    rng = np.random.default_rng(0)
    cost = np.cumsum(rng.random((50, 4, 4)), axis=2)
    cost[:, :, 0] = 0
    got = S.allocate(cost, 3)
    assert (got >= -1).all()
    assert ((got + 1).sum(axis=1) == 3).all()
    options = [o for o in np.ndindex(4, 4, 4, 4) if sum(o) == 3]
    for r in range(50):
        least = min(sum(cost[r, i, u] for i, u in enumerate(o)) for o in options)
        assert np.isclose(sum(cost[r, i, t + 1] for i, t in enumerate(got[r])), least)


def test_near_copies_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    sets = {i: plain_fingerprint(t, 5)[1] for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = classes(ids, pairs)
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(documents).collect()}
    assert got == label
    kept = S.drop_near_copies(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i in ids if label[i] == i})


def test_rows_without_a_key_stay(documents):
    lost = documents.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert S.drop_near_copies(lost).where("doc_id is null").count() == lost.where("doc_id is null").count()


def test_nothing(nothing):
    assert S.near_duplicates(nothing, k=3).collect() == []
    assert S.drop_near_copies(nothing).collect() == []


@pytest.mark.parametrize("fill", [250_000, 40, 7])
def test_components(spark, fill):
    """In one partition, and over rounds of many; with a long path, a hub, loops and nulls."""
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 1), (999, 999)], "a bigint, b bigint")
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    rows = connected_components(df.repartition(3), partition_edges=fill).collect()
    assert {r["node"]: r["component"] for r in rows} == classes(nodes, pairs)
    assert len(rows) == len(nodes)
    assert connected_components(df.where("false")).collect() == []
    named = connected_components(df.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b")), partition_edges=fill).collect()
    text = {f"n{n}" for n in nodes}
    assert {r["node"]: r["component"] for r in named} == classes(text, [(f"n{x}", f"n{y}") for x, y in pairs])


def brute_classes(rows):
    sets = {i: plain_fingerprint(t, 5)[1] for i, t in rows}
    ids = sorted(sets)
    return classes(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_appended_and_truncated_copies_are_found(spark):
    """Runs of new words change many words at once, which no fingerprint over words stands."""
    rng, rows = random.Random(8), []
    for i in range(40):
        base = [f"a{rng.randrange(3000)}" for _ in range(rng.randint(80, 300))]
        extra = [f"b{rng.randrange(3000)}" for _ in range(int(len(base) * rng.choice([0.1, 0.2, 0.23, 0.3])))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + extra if i % 2 else base[: len(base) - len(extra)]))]
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)
    assert 10 < len(set(got.values())) < len(rows)


def edited(rng, frame, edits, tag):
    text = list(frame)
    for at in rng.sample(range(len(frame)), edits):
        text[at] = f"{tag}x{at}"
    return text


def found_classes(spark, texts, **limits):
    """Classes found and true ones, of texts under shuffled ids."""
    ids = list(range(len(texts)))
    random.Random(12).shuffle(ids)
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    got = S.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), **limits).collect()
    return {r["doc_id"]: r["component_id"] for r in got}, brute_classes(rows)


def test_long_texts_of_one_template(spark):
    """Long sets have the least hashes near zero, whatever they hold: only whole sets tell such texts apart."""
    rng, texts = random.Random(9), []
    frame = [f"t{rng.randrange(10**6)}" for _ in range(2000)]
    for c in range(120):
        own = edited(rng, frame, 60, f"c{c}")
        texts += [edited(rng, own, 12, f"d{c}x{i}") for i in range(2)]
    got, true = found_classes(spark, texts)
    assert got == true
    assert len(set(true.values())) == 120


@pytest.mark.parametrize("limits", [{}, {"crowd": 2, "chunk_bytes": 30_000, "shard_entries": 500, "block_bytes": 3000}, {"share": 0.05}, {"share": 1.0, "block_bytes": 1}])
def test_crowded_texts_of_mixed_similarity(spark, limits):
    """Most pairs fail narrowly and a few hubs link the class; also by chains and chunks."""
    rng, texts = random.Random(10), []
    for f in range(2):
        frame = [f"t{rng.randrange(10**6)}" for _ in range(150)]
        for i in range(110):
            texts.append(edited(rng, frame, 1 if i < 2 else 4 if i < 10 else 2, f"d{f}x{i}"))
    got, true = found_classes(spark, texts, **limits)
    assert got == true
    assert 2 < len(set(true.values())) < 60


def test_near_copies_come_through_fingerprints(spark, documents, monkeypatch):
    """The links of all fingerprints are asked for, and what they link is compared whole without candidates from shingles."""
    rows = [(r["doc_id"], r["text"]) for r in documents.dropDuplicates(["doc_id"]).collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked, near_links = [], S.near_links

    def spied(prints, bits):
        asked.append((sorted(r["fp"] for r in prints.collect()), bits))
        return near_links(prints, bits)

    monkeypatch.setattr(S, "near_links", spied)
    true = brute_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in S.near_copies(docs).collect()} == true
    ((fps, bits),) = asked
    assert bits == 3
    first = {frozenset(plain_fingerprint(t, 5)[1]): plain_fingerprint(t, 3)[0] for _, t in rows}
    assert set(fps) == {f - (1 << 64) if f >> 63 else f for f in first.values()}

    # all fingerprints in one group: no candidate from shingles is left but chains, and every pair is still checked
    monkeypatch.setattr(S, "near_links", lambda prints, bits: prints.select(F.lit(min(fps)).alias("a"), F.col("fp").alias("b")))
    assert {r["doc_id"]: r["component_id"] for r in S.near_copies(docs, crowd=10_000).collect()} == true


def test_kin_against_brute_force(spark):
    rng, fps = random.Random(4), []
    for _ in range(30):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(6)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["digest"]: r["kin"] for r in S._kin(spark.createDataFrame(list(enumerate(signed)), "digest bigint, fp bigint"), 3).collect()}
    true = classes(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert len(got) == len(fps)
    assert len(set(got.values())) == len(set(true.values())) == len({(got[i], true[i]) for i in true})
