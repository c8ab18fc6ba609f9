"""Top-k search, sharding, HTML extraction, URL filters, and the pipeline."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import html_extraction as H
from lattica.llm import queries as Q
from lattica.llm import sharding, topk_search
from lattica.llm import url_filters as U


@pytest.mark.parametrize(("n", "d", "block", "k"), [(300, 12, 2048, 5), (300, 12, 16, 5), (4, 3, 4, 5)])
def test_top_k_against_brute_force(spark, n, d, block, k):
    rng = np.random.default_rng(n)
    data = [(i, (rng.standard_normal(d) * rng.choice([0.1, 1, 3])).astype(float).tolist(), 1) for i in range(n)]
    data[1] = (1, data[0][1], 1)
    bad = [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * d, 1), (1150, [float("inf")] * d, 1), (None, [1.0] * d, 1)]
    df = spark.createDataFrame([*data, *bad], "vec_id bigint, embedding array<float>, score int").repartition(3)
    v = np.array([[np.floor(256 * float(np.float32(x))) for x in e] for _, e, _ in data]).astype(np.int64)
    expected = []
    for q in range(0, n, 2):
        best = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:k]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk_search.top_k(df, F.col("vec_id") % 2 == 0, k=k, block_rows=block).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_top_k_prunes_and_takes_nothing(spark):
    rng = np.random.default_rng(0)
    block = (rng.standard_normal((1500, 16)) * (300 * 0.9 ** np.arange(16))).astype(np.int64)
    block = block[np.argsort(-np.linalg.norm(block, axis=1))]
    best = topk_search._Best(10, 5)
    basis = np.linalg.eigh((block.T @ block).astype(float))[1][:, ::-1]
    done = topk_search.search_block(block[:10].copy(), np.arange(10), best.floor.copy(), block, np.arange(1500), basis, best)
    assert done < 0.7 * 10 * 1500
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_search.top_k(none, F.lit(True), k=5).collect() == []


def test_sharding(documents, nothing):
    out = sharding.shard_documents(documents, 7).collect()
    assert len(out) == documents.count()
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(7))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    slots, mixture = defaultdict(list), defaultdict(Counter)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        mixture[r["source"]][r["shard"]] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for per in mixture.values():
        assert max(per.values()) - min(per[s] for s in range(7)) <= 2
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in documents.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == texts
    assert sorted(out) == sorted(sharding.shard_documents(documents.repartition(5), 7).collect())
    assert sharding.shard_documents(nothing, 7).collect() == []


@pytest.mark.parametrize(("shards", "bucket"), [(7, 20_000), (40, 10), (200, 3)])
def test_sharding_against_a_plain_version(documents, shards, bucket):
    """Ranks within sources, one sort by fractional rank, one cut."""
    keyed = documents.select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id").alias("h"), F.xxhash64(F.lit(0), "source").alias("s")).collect()
    by = {}
    for r in keyed:
        by.setdefault(r["source"], []).append((r["h"] & (1 << 62) - 1, r["doc_id"], r["s"]))
    dealt = sorted(((2 * i + 1) / (2 * len(own)), s, h, d) for own in by.values() for i, (h, d, s) in enumerate(sorted(own)))
    n = len(dealt)
    expected = sorted((d, i * shards // n, i - -(-(i * shards // n) * n // shards)) for i, (*_, d) in enumerate(dealt))
    got = sharding.interleave(documents.select("doc_id", "source"), "doc_id", "source", shards, bucket_rows=bucket)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got.collect()) == expected


def test_sharding_replaces_clashing_columns(documents):
    clash = documents.select("doc_id", "source", F.lit("x").alias("shard"), F.lit("y").alias("_hash"), F.lit("z").alias("slot"))
    assert sharding.interleave(clash, "doc_id", "source", 3).columns == ["doc_id", "source", "shard", "slot"]


def test_sharding_in_many_buckets(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("source"))
    out = sharding.interleave(rows, "doc_id", "source", 40, bucket_rows=50).collect()
    by = Counter((r["shard"], r["source"]) for r in out)
    assert {by[s, "hot"] for s in range(40)} <= {49, 50, 51}
    assert {by[s, None] for s in range(40)} <= {24, 25, 26}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="site-header"><p>The name of the site and all of the words that it has in the head of it.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li>About the</li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use the cookies of the site to be of help to all of you who are in here.</div>
<article><header><h1>Head &lt;1&gt;</h1></header><p>It is the first   of the\nparagraphs&nbsp;and <b>it has</b> a lot of the words that are in <a href=x>the</a> language.<br>End
<p>Short.<aside>More of the stories that you have to read in the days to come for all of it</aside>
<p>And it is the last of the paragraphs that there are, as it was for the most of the people who were in it.</p>
<form><label>Name of the person who is to be in on it</label><button>Go</button></form>
<section id="comments"><p>It is a great post and I have to say that it is the best of all that I have read.</p></section></article>
<div class="sidebar"><p>It is in the side of the page that this is, and it has a lot of the words that all have.</p></div>
<footer>&copy; all of the rights are with us and not with you, as it is in all of the world.</footer></body></html>"""


def test_html():
    assert H.main_text(PAGE) == "Head <1>\nIt is the first of the paragraphs and it has a lot of the words that are in the language. End\nShort.\nAnd it is the last of the paragraphs that there are, as it was for the most of the people who were in it."
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text("<article>Only this</article>") == "Only this"
    bare = "<div><a href=1>One</a> <a href=2>Two</a></div><h2>Title</h2><p>It is the text of the page that has all of the words that we have to have in it.</p><p>Bye</p>"
    assert H.main_text(bare).splitlines() == ["Title", "It is the text of the page that has all of the words that we have to have in it.", "Bye"]


def test_html_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "<p>" + "the of and " * 200_000, "x")], "page_id bigint, url string, html string, text string")
    out = {r["page_id"]: r for r in H.extract(df).collect()}
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert (out[2]["text"], out[2]["n_chars"]) == ("", 0)
    assert out[3]["n_chars"] == 200_000 * 11 - 1
    assert H.extract(df).count() == 4
    assert H.extract(df.where("false")).collect() == []


RULES = [U.Rule("allow", "com"), U.Rule("block", "example.com", "/en/"), U.Rule("allow", "www.example.com", "/en/"), U.Rule("block", "net", "/es/")]


def test_url_rules(spark):
    urls = {
        "https://WWW.Example.COM/en/1#x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/2?q": ("a.example.com", "/en/2", "example.com/en/", "block"),
        "http://a.example.com?q=/en/": ("a.example.com", "", None, "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "x://a.net/es/#": ("a.net", "/es/", "net/es/", "block"),
        "x://a.net/es": ("a.net", "/es", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "https://b.org/p?r=http://c.com/": ("b.org", "/p", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    got = [tuple(r)[1:5] for r in U.filter_urls(df, RULES).orderBy("page_id").collect()]
    assert got == list(urls.values())
    assert U.filter_urls(df.where("false"), RULES).collect() == []


def test_aliases_share_decisions(spark):
    pages = [
        (1, "http://a.org/1#f", '<link rel="canonical" href="http://b.net/es/1">'),
        (2, "http://c.org/2", "<META http-equiv=refresh content='0; url=http://a.org/1'>"),
        (3, "http://d.org/3", '<link href="http://e.net/es/9" rel=canonical>'),
        (4, "http://d.org/4", '<link rel="canonical" href="http://f.com/x">'),
        (5, "http://d.org/5", None),
        (6, "http://d.org/6", '<link rel="stylesheet" href="http://b.net/es/1">'),
        (2, "http://c.org/2", "<META http-equiv=refresh content='0; url=http://a.org/1'>"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    more = spark.createDataFrame([("http://d.org/4", "http://d.org/3"), (None, "http://d.org/5")], "a string, b string")
    alone = Counter((r["page_id"], r["verdict"]) for r in U.filter_urls(df, RULES).collect())
    assert alone == {(1, "block"): 1, (2, "block"): 2, (3, "block"): 1, (4, "allow"): 1, (5, "allow"): 1, (6, "allow"): 1}
    # an allowed alias goes before a blocked one
    joined = {r["page_id"]: r["verdict"] for r in U.filter_urls(df, RULES, edges=more).collect()}
    assert joined == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_targets_are_resolved(spark):
    base = "http://a.org/dir/page?x=1#f"
    cases = {
        '<link rel=canonical href="index.html">': ["http://a.org/dir/index.html"],
        '<link rel="alternate canonical" href="../up/./x">': ["http://a.org/up/x"],
        '<base href="/b/"><link rel=canonical href=y>': ["http://a.org/b/y"],
        '<link rel=canonical href=y><base href="http://c.org/"><base href="http://d.org/">': ["http://c.org/y"],
        "<link rel=canonical href='//o.org/p'>": ["http://o.org/p"],
        "<link rel=canonical href='?q=2&amp;r=3'>": ["http://a.org/dir/page?q=2&r=3"],
        "<META HTTP-EQUIV='Refresh' CONTENT='5;URL=z'><link rel=CANONICAL href=w>": ["http://a.org/dir/z", "http://a.org/dir/w"],
        "<meta http-equiv=refresh content=\"0; url='v'\">": ["http://a.org/dir/v"],
        "<meta http-equiv=refresh content=30>": [],
        "<!-- <link rel=canonical href=no> --><script>'<link rel=canonical href=no>'</script>": [],
        "<link rel=canonical>": [],
        "<link rel=canonical href='http://[bad'>": [],
        "<link rel=canonical " * 50_000: [],
    }
    for html, targets in cases.items():
        assert U.page_targets(base, html) == targets, html[:80]
    keys = spark.createDataFrame([("HTTP://Other.ORG",), ("http://other.org/A?B#c",), ("no",), (None,)], "u string").select(U.page_key(F.col("u"))).collect()
    assert [k[0] for k in keys] == ["http://other.org/", "http://other.org/A?B", None, None]


def test_relative_names_tie_no_strangers(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://bad.net/es/a", link.format("index.html")),
        (2, "http://good.org/x", link.format("index.html")),
        (3, "http://q.org/1", link.format("HTTP://Bad.net/es/a")),
        (4, "http://r.org/1", link.format("http://q.org/1") + link.format("http://r.org/2")),
        (5, "http://r.org/2", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in U.filter_urls(df, RULES).collect()} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block"}


def test_queries_are_named_and_guarded():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries() if n.startswith("op")) == list(range(1, 11))
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_the_library_does_not_import_the_subpackage():
    import subprocess
    from pathlib import Path

    code = "import sys, lattica, lattica.catalog, lattica.sources.delimited, lattica.streaming.frames; print(any(m.startswith('lattica.llm') for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=False)
    assert out.stdout.split()[-1:] == ["False"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def text(n):
        return ". ".join(" ".join(rng.choice(vocabulary) for _ in range(10)) for _ in range(n))

    docs = [(i, text(rng.randint(3, 12)) + (". vile scum vile" if i % 6 == 0 else ""), "aa" if i % 4 else "bb", "s", 0) for i in range(240)]
    item = text(2)
    docs += [(300, docs[1][1], "aa", "s", 0), (301, docs[2][1].replace(". ", " new. ", 1), "aa", "s", 0), (302, docs[5][1] + ". " + item, "aa", "s", 0), (303, "12 34", "aa", "s", 0), (304, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i, *_ in docs if i < 240 and i % 6}
    assert not kept & {i for i in range(0, 240, 6)}
    assert not kept & {300, 302, 303, 304}
    assert len(clean - kept) <= 1
