"""The subpackage's queries, at production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, text_crc32_mod


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = text_crc32_mod("doc_id", 4) == 2
    out = identify(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=8, min_items=2).drop("item_ids")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.lm_scoring import score_documents

    held_out = text_crc32_mod("doc_id", 5) == 1
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out, min_count=1)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, bits=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import fit, score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = text_crc32_mod("doc_id", 3) == 1
    out = score_texts(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.url_filters import Rule, filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), [Rule(*r) for r in RULES])


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under redirects such as sites make: to the url without its query, to https, to the main host, to an archive
    of a hundred pages. Only some hosts have rules, so most verdicts come over several steps from an alias."""
    from lattica.llm.url_filters import Rule, filter_urls

    pages = table(spark, sf_dir, "pages")
    steps = [F.col("url")]
    for pattern, new in _REDIRECTS:
        steps.append(F.regexp_replace(steps[-1], pattern, new))
    pairs = F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in zip(steps, steps[1:], strict=False)))
    edges = pages.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    return filter_urls(pages, [Rule(*r) for r in ALIAS_RULES], edges=edges)


_REDIRECTS = ((r"[?#].*$", ""), ("^http:", "https:"), (r"://[^/]*[.]example[.]", "://example."), (r"/([0-9]+)[0-9][0-9]([.]html|/)?$", "/$1"))
ALIAS_RULES = (
    *(("block", f"{host}.example.{top}", "/") for host in ("spam-farm", "cheap-pills", "ads-track") for top in ("com", "net", "org")),
    ("block", "m.example.com", "/"), ("allow", "thther.example.org", "/"), ("allow", "ththed.example.org", "/en/"), ("block", "example.net", "/fr/9"), ("allow", "ththble.example.net", "/"),
)
#: Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def queries() -> dict:
    return {f.__name__: f for f in (url_alias_verdicts, op1_exact_topk, op2_best_fit_packing, op3_language_id, op4_sharding, op5_html_extraction, op6_decontamination, op7_lm_scoring, op8_simhash_near_dedup, op9_toxicity, op10_url_filters)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def _rules_sql(rules) -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)


def _parts_sql(source: str) -> str:
    """(id, host, path, rest) of the urls of source(id, url)."""
    return f"""SELECT id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM {source})"""


_FITS_SQL = """SELECT id, max_by(struct_pack(r := rhost || rpath, v := verdict), length(rhost || rpath)) AS best
  FROM {} JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id"""

#: The rules' part. No page of the test tables names an alias; see ALIAS_SQL.
OP10_SQL = f"""
WITH parts AS (
  {_parts_sql("(SELECT page_id AS id, url FROM pages)")}
), rules(verdict, rhost, rpath) AS (VALUES {_rules_sql(RULES)}
), fits AS (
  {_FITS_SQL.format("parts")}
)
SELECT parts.id AS page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_component
FROM parts LEFT JOIN fits USING (id)
"""

_KEY_SQL = """lower(regexp_extract({0}, '^([^:/?#]+://[^/?#]*)', 1)) || CASE WHEN regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
  ELSE regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END || regexp_extract({0}, '^[^:/?#]+://[^/?#]*[^?#]*([?]?[^#]*)', 1)"""

ALIAS_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT page_id, url AS s0, regexp_replace(url, '[?#].*$', '') AS s1, regexp_replace(s1, '^http:', 'https:') AS s2,
         regexp_replace(s2, '://[^/]*[.]example[.]', '://example.') AS s3, regexp_replace(s3, '/([0-9]+)[0-9][0-9]([.]html|/)?$', '/\\1') AS s4 FROM pages
), keys AS (
  SELECT page_id, {", ".join(f"{_KEY_SQL.format(f's{i}')} AS k{i}" for i in range(5))} FROM steps
), ways AS (
  {" UNION ".join(f"SELECT k{i} AS a, k{i + 1} AS b FROM keys WHERE k{i} <> k{i + 1} UNION SELECT k{i + 1}, k{i} FROM keys WHERE k{i} <> k{i + 1}" for i in range(4))}
), met(id, other) AS (
  SELECT a, a FROM ways UNION SELECT met.id, ways.b FROM met JOIN ways ON met.other = ways.a
), classes AS (SELECT id, min(other) AS component FROM met GROUP BY id
), rules(verdict, rhost, rpath) AS (VALUES {_rules_sql(ALIAS_RULES)}
), parts AS (
  {_parts_sql("(SELECT page_id AS id, url FROM pages)")}
), fits AS (
  {_FITS_SQL.format("parts")}
), node_parts AS (
  {_parts_sql("(SELECT id, id AS url FROM classes)")}
), node_fits AS (
  {_FITS_SQL.format("node_parts")}
), decided AS (
  SELECT component, max(CASE best.v WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS d FROM classes LEFT JOIN node_fits USING (id) GROUP BY component
)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN d = 1 THEN 'block' ELSE 'allow' END) AS verdict, component AS alias_component
FROM parts JOIN keys ON parts.id = page_id LEFT JOIN fits ON fits.id = page_id LEFT JOIN classes ON classes.id = k0 LEFT JOIN decided USING (component)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op6_decontamination": OP6_SQL, "op10_url_filters": OP10_SQL, "url_alias_verdicts": ALIAS_SQL}
