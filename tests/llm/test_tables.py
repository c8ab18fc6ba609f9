"""Queries and pipeline stages on the test tables, against plain versions and known labels."""

import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import language_id, queries, toxicity
from lattica.llm.common import table, text_crc32_mod

from .test_decontamination import brute
from .test_simhash import brute_classes

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(MIDDLE).is_dir(), reason="no test tables here")


def held(doc_id, divisor, rest):
    return zlib.crc32(str(doc_id).encode()) % divisor == rest


def test_languages_of_held_out_documents(spark):
    known = {r["doc_id"]: r["lang"] for r in table(spark, MIDDLE, "documents").collect()}
    rows = queries.op3_language_id(spark, MIDDLE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    asked = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and known[r["doc_id"]]]
    assert len(asked) > 100
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in asked) >= 0.97 * len(asked)


def test_toxicity_of_held_out_documents(spark):
    known = {r["doc_id"]: r["toxic"] for r in table(spark, MIDDLE, "labels").collect()}
    rows = queries.op9_toxicity(spark, MIDDLE).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    asked = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    toxic = sum(y for y, _ in asked)
    assert toxic > 5
    assert sum(p for y, p in asked if y) >= 0.8 * toxic  # learnt from some 260 labels only
    assert sum(p for y, p in asked if not y) <= 0.02 * (len(asked) - toxic)


def test_stages_against_plain_versions(spark):
    """Each stage on all that the one before kept, and the whole run."""
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SMALL, "documents")
    columns = docs.columns

    def ids(df):
        assert df.columns == columns
        return sorted(r["doc_id"] for r in df.collect())

    rows = docs.collect()
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, SMALL, "labels").select("doc_id", "toxic"), text_crc32_mod("doc_id", 3) != 1)
    kept = stages["toxicity"](spark, docs, SMALL)
    assert ids(kept) == sorted(r["doc_id"] for r in rows if model.score(r["text"])[0] < corpus_pipeline.TOXIC)

    rows = kept.collect()
    known = language_id.fit(kept.select("doc_id", "text", "lang"), text_crc32_mod("doc_id", 4) != 2)
    found = known.predict([r["text"] for r in rows])
    kept = stages["language_id"](spark, kept, SMALL)
    assert ids(kept) == sorted(r["doc_id"] for r, (lang, p) in zip(rows, found, strict=True) if lang != "und" and p >= corpus_pipeline.LEAST_LANGUAGE)

    label = brute_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    kept = stages["simhash_near_dedup"](spark, kept, SMALL)
    assert ids(kept) == sorted(i for i, c in label.items() if i == c)

    tests = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    found = brute([(r["doc_id"], r["text"]) for r in kept.collect()], tests, 8, 1)
    kept = stages["benchmark_decontamination"](spark, kept, SMALL)
    assert ids(kept) == sorted(d for d, _, hit, *_ in found if not hit)

    last = ids(kept)
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).orderBy("sequence_id", "offset").collect()]
    assert sorted({p[0] for p in pieces}) == last
    ends = defaultdict(int)
    for _, _, _, length, _, sequence, offset in pieces:
        assert offset == ends[sequence]
        ends[sequence] += length
    assert max(ends.values()) <= 2048
    assert len(ends) == -(-sum(ends.values()) // 2048)


def test_fingerprint_classes_of_the_test_tables(spark):
    from .test_simhash import classes, plain_fingerprint

    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    prints = {i: plain_fingerprint(t, 3)[0] for i, t in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    label = classes(sorted(prints), pairs)
    got = queries.op8_simhash_near_dedup(spark, SMALL).select("doc_id", "fingerprint", F.col("component_id")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", label[i]) for i in prints}
