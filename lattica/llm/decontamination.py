"""Benchmark decontamination on a distributed positional inverted index. DataFrame functions only.

1. One pass counts how often each test term stands in the training text.
2. Each test window's terms are ordered from the rarest. A second pass takes the postings (document, position) of the
   windows' rarest terms, shifts them by the term's offset to the window's start, and keeps the starts that the second
   rarest term confirms. Around those starts it stores the postings of all terms: any occurrence of a window holds its
   rarest terms, so this index, cut down to their surroundings, loses no match.
3. The stored lists of all terms of a window, each shifted by its offset, are intersected: a start that every list holds
   is an exact phrase match. Proximity matches let each term stand up to slop words off its place.

What is broadcast is the test set's terms and windows, if their windows' terms count no more than broadcast_rows. Beyond that
the second pass deals its tokens by term, without the texts, and brings the starts back to the texts; adaptive execution
splits hot terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ascii_lower, cut

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    """An empty string, the text's words in order, and at times another empty string."""
    text = F.coalesce(text, F.lit(""))
    # lower() is faster than translate(), and equal unless a capital outside A-Z occurs
    low = F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), ascii_lower(text)).otherwise(F.lower(text))
    return F.split(F.concat(F.lit(" "), low), _GAP)


def _count(split: Column) -> Column:
    size = F.size(split)
    return (size - 1 - F.when((size > 1) & (F.element_at(split, -1) == ""), 1).otherwise(0)).cast("long")


def item_windows(items: DataFrame, k: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, terms) of every k consecutive words of an item; an item of fewer, but not none, is one window."""
    words = items.select(key, _split(F.col(text)).alias("_s")).select(key, F.slice("_s", F.lit(2), _count(F.col("_s")).cast("int")).alias("_w")).where(F.size("_w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - (k - 1), F.lit(1))))
    return words.select(key, "_w", starts.alias("_i")).select(key, F.slice("_w", F.col("_i"), F.lit(k)).alias("terms")).distinct()


def _is_small(df: DataFrame, rows: int) -> bool:
    """Whether a written copy has rows rows at most."""
    return df.limit(rows + 1).count() <= rows


class PositionalIndex:
    """The postings that can take part in a match, and the documents' word counts."""

    def __init__(self, docs: DataFrame, items: DataFrame, k: int, slop: int = 0, doc_key: str = "doc_id", item_key: str = "item_id", broadcast_rows: int = 500_000) -> None:
        self.slop, self.doc_key, self.item_key = slop, doc_key, item_key
        found = cut(item_windows(items, k, item_key))
        windows = cut(found.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()))
        self.members = found.join(windows, "terms").select("wid", item_key)
        spread = windows.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
        vocabulary = spread.select("term").distinct()
        small = _is_small(spread, broadcast_rows)
        # a document is its key and its text: rows that differ in either are told apart
        split = docs.select(F.col(doc_key).alias("doc"), F.xxhash64("text").alias("txt"), _split(F.col("text")).alias("words"))
        terms = split.select(F.explode("words").alias("term")).join(F.broadcast(vocabulary) if small else vocabulary, "term").groupBy("term").agg(F.count("*").alias("cf"))
        ordered = spread.join(cut(terms), "term").groupBy("wid", "len").agg(F.sort_array(F.collect_list(F.struct("cf", "off", "term"))).alias("by"))
        # a window one of whose terms never occurs cannot occur; k terms a window at most, so the lists are short
        live = cut(ordered.where(F.size("by") == F.col("len")))
        second = F.get("by", F.lit(1))
        rare = live.select("wid", "len", F.get("by", F.lit(0))["term"].alias("term"), F.get("by", F.lit(0))["off"].alias("off"), second["term"].alias("term2"), second["off"].alias("off2"))
        first, around = F.greatest(F.col("start") - slop, F.lit(1)), F.col("start") + F.col("len") + slop
        if slop:
            fits = F.col("wid").isNotNull()
        else:
            fits = (F.col("start") >= 1) & (F.col("start") + F.col("len") <= F.size("words")) & (F.col("term2").isNull() | F.get("words", F.col("start") + F.col("off2")).eqNullSafe(F.col("term2")))
        start = (F.col("pos") - F.col("off")).cast("int")
        if small:
            # the words stay where they are: only the surroundings of hits are copied. Position 0 of a row is its count of words
            tokens = split.select("doc", "txt", "words", F.posexplode("words").alias("pos", "term"))
            hits = tokens.join(F.broadcast(rare), "term", "left").withColumn("start", start).where((F.col("pos") == 0) | fits)
        else:
            # thin tokens are dealt by term; the starts that they give go back to the texts
            thin = split.select("doc", "txt", F.posexplode("words").alias("pos", "term")).join(rare, "term")
            starts = thin.select(F.col("doc").alias("_doc"), F.col("txt").alias("_txt"), "wid", "len", "off2", "term2", start.alias("start")).distinct()
            at = split.join(starts, split["doc"].eqNullSafe(starts["_doc"]) & split["txt"].eqNullSafe(starts["_txt"])).where(fits)
            hits = at.select("doc", "txt", "words", "wid", "len", "start", F.lit(1).alias("pos"))
            hits = hits.unionByName(split.select("doc", "txt", "words", F.lit(0).alias("pos")), allowMissingColumns=True)
        near = F.when(F.col("pos") > 0, F.slice("words", first + 1, F.greatest(around - first, F.lit(0))))
        stored = cut(hits.select("doc", "txt", F.when(F.col("pos") == 0, _count(F.col("words"))).alias("n_words"), "wid", "start", first.cast("int").alias("first"), near.alias("around")))
        self.documents = stored.where("n_words is not null").select("doc", "txt", "n_words")
        self.starts = stored.where("n_words is null").select("doc", "txt", "wid", "start").distinct()
        placed = stored.where("n_words is null").select("doc", "txt", "first", F.posexplode("around").alias("at", "term"))
        self.postings = placed.where("term <> ''").select("doc", "txt", "term", (F.col("first") + F.col("at")).alias("pos")).distinct()
        self.windows = live.select("wid", "len", F.explode("by").alias("t")).select("wid", "len", F.col("t.off").alias("off"), F.col("t.term").alias("term"))

    def matches(self) -> DataFrame:
        """(doc, txt, wid, start, len): starts (from 1) at which every term of the window stands at its place, or within slop of it."""
        asked = self.starts.join(self.windows, "wid").withColumn("place", F.col("start") + F.col("off"))
        if self.slop:
            # the few places that a term may take, so that the join stays an equi-join
            asked = asked.withColumn("place", F.explode(F.sequence(F.col("place") - self.slop, F.col("place") + self.slop)))
        post = self.postings.withColumnsRenamed({"doc": "_d", "txt": "_t", "term": "_w"})
        held = asked.join(post, asked["doc"].eqNullSafe(post["_d"]) & asked["txt"].eqNullSafe(post["_t"]) & (asked["place"] == post["pos"]) & (asked["term"] == post["_w"]))
        full = held.groupBy("doc", "txt", "wid", "start", "len").agg((F.count_distinct("off") if self.slop else F.count("*")).alias("n"))
        return full.where("n = len").drop("n")


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 8, min_items: int = 2, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids) for every row of docs.

    n_hit counts the words inside any match; n_items the items with a match. A null or wordless text has zeros and the
    digest of an empty list; wordless items never match; with no items nothing is hit; repeated rows each get their row.
    """
    index = PositionalIndex(docs, items, k, slop)
    found = cut(index.matches())
    last = F.col("start") + F.col("len") - 1
    words = found.select("doc", "txt", F.explode(F.sequence("start", last)).alias("pos")).distinct()
    n_hit = words.groupBy("doc", "txt").agg(F.count("*").alias("n_hit"))
    owned = found.select("doc", "txt", "wid").distinct().join(index.members, "wid").select("doc", "txt", F.col(index.item_key).cast("string").alias("item")).distinct()
    items_of = owned.groupBy("doc", "txt").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    hit = n_hit.join(items_of, n_hit["doc"].eqNullSafe(items_of["doc"]) & n_hit["txt"].eqNullSafe(items_of["txt"])).select(n_hit["doc"].alias("_d"), n_hit["txt"].alias("_t"), "n_hit", "item_ids")
    every = index.documents
    out = every.join(hit, every["doc"].eqNullSafe(hit["_d"]) & every["txt"].eqNullSafe(hit["_t"]), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_items = F.size(ids).cast("long")
    return out.select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), ids.alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 8, min_items: int = 1) -> DataFrame:
    """docs without those in which k-word windows of min_items or more items occur; all their columns and rows else."""
    index = PositionalIndex(docs, items, k)
    owned = index.matches().select("doc", "txt", "wid").distinct().join(index.members, "wid").select("doc", "txt", index.item_key).distinct()
    bad = owned.groupBy("doc", "txt").agg(F.count("*").alias("n")).where(F.col("n") >= min_items)
    bad = cut(bad.select(F.col("doc").alias("_doc"), F.col("txt").alias("_txt")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_txt"]), "left_anti")
