"""Connected components over an edge table: contraction within partitions, and alternating large-star and small-star rounds.

Edges stay distributed. A round first replaces each partition's edges by stars to the least node that they reach within
the partition; then two grouped minima with map-side combining and two equi-joins, whose skewed keys adaptive execution
splits, bring the partitions' stars together. Partitions are as many as the edges left fill, so that a small table needs
no round at all. Each step ends with a written checkpoint, so lost executors cost one step at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n rows: the smallest row reachable over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = least_reached(place[: len(u)], place[len(u) :], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contracted(most: int):
    """A partition's edges as stars; they are folded whenever most of them have gathered, so that only nodes are held."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in it:
            held.append((pdf["u"].to_numpy(), pdf["v"].to_numpy()))
            if sum(len(u) for u, _ in held) >= 2 * most + 2 * len(held[0][0]):
                held = [_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            u, v = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pd.DataFrame({"u": u, "v": v})

    return run


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", partition_edges: int = 250_000) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Null ends and loops are left out (a node with a loop only gets no row); repeated edges count once;
    an empty table gives an empty result. Any orderable type of node will do.
    """
    kind = dict(edges.dtypes)[a]
    schema = f"u {kind}, v {kind}"
    # written first: with edges made by Python, a task would hold two workers, which stay
    pairs = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v"))
    now = cut(pairs.mapInPandas(_contracted(partition_edges), schema))
    seen = _signature(now)
    while True:
        parts = 1 + seen[0] // partition_edges
        few = lambda df: df.coalesce(parts)  # noqa: B023, E731 (the writers of a step are as many as its edges fill)
        now = cut(few(now).mapInPandas(_contracted(partition_edges), schema))
        if parts == 1:
            break
        now = cut(few(_large_star(now)))
        now = cut(few(_small_star(now)).distinct())
        new = _signature(now)
        if new == seen:
            break
        seen = new
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
