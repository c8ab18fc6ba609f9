"""URL filters over redirect-equivalent aliases.

Explicit rules decide the urls they fit. A url that no rule fits takes its decision from its aliases: the urls
that a redirect or a canonical link ties it to, over any number of steps. Among the aliases an explicit allow
goes before a block; with neither, the url is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ascii_lower, batches, cut, narrow
from lattica.llm.components import connected_components
from lattica.llm.html_extraction import tokens

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A refresh: seconds, then a target, perhaps named and in quotes.
_REFRESH = re.compile(r"\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(?:'([^']*)|\"([^\"]*)|(.*))", re.I | re.S)


@dataclass(frozen=True)
class Rule:
    """A decision for a host with its subdomains and every path that starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or url."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """From after the host up to ? # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; ties go to an allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def page_key(url: Column) -> Column:
    """What names a page: scheme and host in lower case (A-Z), the path (/ if there is none) and the query, no fragment; null without ://."""
    whole = r"^([^:/?#]+://[^/?#]*)([^?#]*)(\??[^#]*)"
    path = F.regexp_extract(url, whole, 2)
    key = F.concat(ascii_lower(F.regexp_extract(url, whole, 1)), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, whole, 3))
    return F.when(url.rlike(r"^[^:/?#]+://"), key)


def page_targets(url: str | None, html: str) -> list[str]:
    """Every target that the page's canonical links and refreshes name, resolved against its base and url; comments, scripts
    and styles do not count."""
    base, bases, found = url or "", [], []
    for _, tag, closes, text in tokens(html):
        if closes or tag not in ("link", "meta", "base"):
            continue
        held: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(text):
            held.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or "").strip())
        if tag == "base":
            bases.append(held.get("href", ""))
        elif tag == "link" and "canonical" in held.get("rel", "").lower().split():
            found.append(held.get("href", ""))
        elif tag == "meta" and held.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(held.get("content", ""))):
            found.append((m[1] or m[2] or m[3] or "").strip())
    base = _joined(base, next(filter(None, bases), "")) or base  # the first base holds for the whole page
    return [full for target in found if target and (full := _joined(base, target))]


def _joined(base: str, target: str) -> str | None:
    """The target's full url; None if it is none."""
    try:
        return urljoin(base, target)
    except ValueError:
        return None


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) pages that a canonical link or a refresh redirect ties together.

    Only pages that name a canonical link or a refresh are read by Python; a page may name any number of targets.
    """
    schema = pa.schema([("a", pa.string()), ("t", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 22):
            pairs = [(u, t) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in page_targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())], schema=schema)

    named = pages.where(F.col(html).rlike(r"(?i)canonical|refresh") & page_key(F.col(url)).isNotNull()).select(F.col(url), F.col(html))
    found = narrow(named).mapInArrow(run, "a string, t string")
    return found.select(page_key(F.col("a")).alias("a"), page_key(F.col("t")).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, alias_component) for every row of pages.

    edges: more (a, b) pairs of equivalent urls, such as a crawler's redirect log. A null url has an empty host
    and path and is allowed; repeated rows each get a row; an empty table gives no rows; other columns of pages
    play no part. alias_component is the smallest url of the alias class, null if the url has no alias.
    """
    links = page_edges(pages, url, html) if html else None
    if edges is not None:
        more = edges.select(page_key(F.col("a")).alias("a"), page_key(F.col("b")).alias("b"))
        links = more if links is None else links.unionAll(more)
    host, path = url_host(F.col(url)), url_path(F.col(url))
    judged = pages.select(F.col(key).alias(key), page_key(F.col(url)).alias("_url"), host.alias("host"), path.alias("path")).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    own = judged.select(key, "host", "path", F.col("_rule.rule").alias("rule"), "_url", F.col("_rule.verdict").alias("_verdict"))
    links = None if links is None else cut(links.distinct())
    if links is None or links.isEmpty():
        return own.select(key, "host", "path", "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_component"))
    nodes = connected_components(links)
    ruled = nodes.withColumn("_r", rule_for(url_host(F.col("node")), url_path(F.col("node")), rules))
    by_class = ruled.groupBy("component").agg(F.max(F.when(F.col("_r.verdict") == "allow", 2).when(F.col("_r.verdict") == "block", 1).otherwise(0)).alias("_d"))
    # one row a url on this side, so a hot url on the pages' side is split by the skew join
    known = nodes.join(by_class, "component").select(F.col("node").alias("_url"), F.col("component").alias("alias_component"), "_d")
    out = own.join(known, "_url", "left")
    method = F.when(F.col("_d") == 1, "block").otherwise("allow")
    return out.select(key, "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "alias_component")
