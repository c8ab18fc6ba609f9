"""Joins and positional merges of keyed rows.

join pairs every left with every right row of a key; merge pairs the i-th left with the i-th right row of a key. Both are
equi-joins that Catalyst plans: broadcast if a side is known to be small, else sort-merge with skewed keys split. A join that
makes many rows of few is dealt out first, as Spark plans tasks by what they read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.positions import occurrence

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
#: A join that makes over MANY rows, and over WIDER rows for each that it reads, is dealt to tasks of about MANY rows, MOST tasks at most.
MANY, WIDER, MOST = 5_000_000, 4, 10_000
MERGES = {"inner": "inner", "outer": "full"}


def _sided(df: DataFrame, side: str, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with its key and order columns marked by side; the caller has told the cell columns apart."""
    order = [c for c in order if c != "__k"]
    renames = {"__k": f"__k{side}"} | {c: f"__o{side}{i}" for i, c in enumerate(order)}
    return df.withColumnsRenamed(renames), [renames[c] for c in order]


def _renumbered(df: DataFrame, orders: list[str]) -> tuple[DataFrame, list[str]]:
    renames = {c: f"__o{i}" for i, c in enumerate(orders)}
    return df.withColumnsRenamed(renames), ["__k", *renames.values()]


def _dealt(a: DataFrame, b: DataFrame, how: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sides with a share in columns __sl and __sr if their join makes many rows of few: rows of one side are dealt to shares,
    those of the other stand in each. Rows that the join will make are estimated from its sides' rows and different keys."""
    if how == "outer" or a.isStreaming or b.isStreaming:
        return a, b, []
    (n, keys), (m, others) = (df.agg(F.count(k), F.approx_count_distinct(k)).first() for df, k in ((a, "__kl"), (b, "__kr")))
    made = n * m // max(1, keys, others)
    if made <= max(MANY, WIDER * (n + m)):
        return a, b, []
    tasks = min(MOST, -(-made // MANY))
    shares = -(-tasks * 4 // max(1, min(keys, others)))
    left = how == "left" or how == "inner" and n >= m
    one, all_, key, other = (a, b, "l", "r") if left else (b, a, "r", "l")
    one = one.withColumn(f"__s{key}", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int"))
    all_ = all_.withColumn(f"__s{other}", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    # a set number of parts is not brought together by size
    one, all_ = (df.repartition(tasks, f"__k{x}", f"__s{x}") for df, x in ((one, key), (all_, other)))
    return (one, all_, ["__sl", "__sr"]) if left else (all_, one, ["__sl", "__sr"])


def key_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], how: str) -> tuple[DataFrame, list[str]]:
    """The join on __k, and its order: by key, then left, then right order."""
    a, lo = _sided(left, "l", left_order)
    b, ro = _sided(right, "r", right_order)
    # a side in order of its keys alone has each once
    a, b, dealt = (a, b, []) if not lo or not ro else _dealt(a, b, how)
    same = a["__kl"] == b["__kr"]
    if dealt:
        same = same & (a["__sl"] == b["__sr"])
        b = b.hint("merge")
    out = a.join(b, same, JOINS[how]).withColumn("__k", F.coalesce("__kl", "__kr")).drop("__kl", "__kr", *dealt)
    orders = list(dict.fromkeys(c for c in [*lo, *ro] if c in out.columns))
    return _renumbered(out, orders)


def key_merge(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], how: str) -> tuple[DataFrame, list[str]]:
    """The positional merge on __k: by key, then occurrence."""
    a, lo = _sided(left, "l", left_order)
    b, ro = _sided(right, "r", right_order)
    a = occurrence(a, ["__kl"], lo or ["__kl"], "__il")
    b = occurrence(b, ["__kr"], ro or ["__kr"], "__ir")
    out = a.join(b, (a["__kl"] == b["__kr"]) & (a["__il"] == b["__ir"]), MERGES[how])
    out = out.withColumn("__k", F.coalesce("__kl", "__kr")).withColumn("__pos", F.coalesce("__il", "__ir").cast("bigint"))
    gone = [c for c in out.columns if c.startswith(("__kl", "__kr", "__il", "__ir", "__ol", "__or"))]
    return out.drop(*gone), ["__k", "__pos"]
