"""Exact top-k inner products: candidates by descending norm, rotated partial sums, Cauchy-Schwarz residual bounds.

Candidates are range-partitioned by descending norm into bands and packed into blocks. The longest vectors give every
query a first threshold, its k-th best score so far. A band is visited by the queries that |q| times the band's largest
norm can still lift to their threshold, so short vectors are never read for most queries. Within a block, vectors are
rotated by the right singular vectors of the table, which moves their weight to the first coordinates: the partial sum
over a few of those plus the product of the residual norms bounds the score, and only pairs whose bound reaches the
threshold are multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

_STEP = 512


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, vec, norm): floor(scale * x) of each component, packed as 64-bit integers.

    Rows whose key or vector is null, or whose vector holds a null or non-finite component, are left out.
    """
    x = F.col(vector)
    whole = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            vecs = [np.asarray(v, np.int64) for v in pdf["v"]]
            yield pd.DataFrame({"id": pdf["id"], "vec": [v.tobytes() for v in vecs], "norm": [float(np.sqrt((v.astype(float) ** 2).sum())) for v in vecs]})

    return rows.where(whole).select(F.col(key).cast("long").alias("id"), ints.alias("v")).mapInPandas(pack, "id long, vec binary, norm double")


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of int64; shorter vectors end in zeros."""
    out = np.zeros((len(blobs), width), np.int64)
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, largest singular value first (width x width)."""

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in it:
            m = _matrix(list(pdf["vec"]), width).astype(float)
            total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(width * width), "x": total.ravel()})

    sums = vectors.select("vec").mapInPandas(moments, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    gram = np.zeros(width * width)
    for cell, x in sums.collect():  # width * width cells, whatever the input
        gram[cell] = x
    _, basis = np.linalg.eigh(gram.reshape(width, width))
    return np.ascontiguousarray(basis[:, ::-1])


class _Best:
    """The k best (score, id) of each query so far: larger scores first, ties to the smaller id, an id once."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.q, self.id, self.score = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((-score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, bool)
        q, ids, score = q[new], ids[new], score[new]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.q, self.id, self.score = q[kept], ids[kept], score[kept]
        last = rank == self.k - 1
        np.maximum.at(self.floor, q[last], score[last].astype(float))


def search_block(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, block: np.ndarray, block_ids: np.ndarray, basis: np.ndarray, best: _Best) -> int:
    """Offer the block's rows (longest first) to best; returns how many pairs were multiplied out.

    floor: the thresholds known beforehand. A pair whose bound equals its threshold still counts, as ties go by id.
    """
    width = queries.shape[1]
    few = max(1, width // 4)
    q_rot, done = queries @ basis, 0
    q_rest, q_norm = np.sqrt((q_rot[:, few:] ** 2).sum(axis=1)), np.sqrt((q_rot**2).sum(axis=1))
    np.maximum(best.floor, floor, out=best.floor)
    for at in range(0, len(block), _STEP):
        part, ids = block[at : at + _STEP], block_ids[at : at + _STEP]
        c_rot = part @ basis
        c_norm = np.sqrt((c_rot**2).sum(axis=1))
        slack = 1e-9 * q_norm * c_norm.max(initial=0) + 1e-6
        live = np.flatnonzero(q_norm * c_norm.max(initial=0) + slack >= best.floor)
        if not len(live):
            continue
        bound = q_rot[live, :few] @ c_rot[:, :few].T
        bound += np.outer(q_rest[live], np.sqrt((c_rot[:, few:] ** 2).sum(axis=1)))
        hit = (bound + slack[live, None] >= best.floor[live, None]) & (query_ids[live, None] != ids[None, :])
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        i = live[i]
        done += len(i)
        score = np.empty(len(i), np.int64)
        for s in range(0, len(i), 1 << 15):
            score[s : s + (1 << 15)] = (queries[i[s : s + (1 << 15)]] * part[j[s : s + (1 << 15)]]).sum(axis=1)
        # a first cut by the thresholds as they are keeps the sort small
        good = score >= best.floor[i]
        best.add(i[good], ids[j[good]], score[good])
    return done


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block_rows: int = 2048, most_bands: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows that is_query (a condition on key) holds for; candidates are all rows but those of the query's
    own key. Fewer candidates give fewer rows. A key that is repeated counts once, at its best score; shorter vectors
    count as if they ended in zeros; an empty table gives no rows.
    """
    vectors = cut(integer_vectors(rows, key, vector, scale))
    n, longest = vectors.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    schema = "query_id long, vec_id long, score long"
    width = max(1, (longest or 0) // 8)
    basis = rotation(vectors, width)
    bands = max(1, min(most_bands, -(-n // (4 * block_rows))))
    dealt = vectors.repartitionByRange(bands, F.col("norm").desc(), F.xxhash64("id")).sortWithinPartitions(F.col("norm").desc())

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band = TaskContext.get().partitionId()
        for pdf in it:
            for at in range(0, len(pdf), block_rows):
                part = pdf.iloc[at : at + block_rows]
                yield pd.DataFrame({"band": [band], "top": [part["norm"].max()], "ids": [part["id"].to_numpy(np.int64).tobytes()], "block": [_matrix(list(part["vec"]), width).tobytes()]})

    blocks = cut(dealt.mapInPandas(pack, "band int, top double, ids binary, block binary"))
    tops = sorted((-r["top"], r["band"]) for r in blocks.groupBy("band").agg(F.max("top").alias("top")).collect())  # one row a band
    top_norm, top_band = -np.array([t for t, _ in tops]), np.array([b for _, b in tops], np.int32)
    seeds = vectors.orderBy(F.col("norm").desc(), "id").limit(block_rows).collect()  # one block of the longest
    seed_ids = np.array([r["id"] for r in seeds], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((seed_ids, _matrix([bytes(r["vec"]) for r in seeds], width), basis))

    def visit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_, seeds_, basis_ = shared.value
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                q, qid = _matrix(list(part["vec"]), width), part["id"].to_numpy(np.int64)
                best = _Best(len(q), k)
                search_block(q, qid, best.floor, seeds_, ids_, basis_, best)
                reach = part["norm"].to_numpy() * (1 + 1e-9) + 1e-9
                # the bands are in order of their largest norm: each query visits the first few of them
                visits = (reach[:, None] * top_norm[None, :] + 1e-6 >= best.floor[:, None]).sum(axis=1)
                for b in range(int(visits.max(initial=0))):
                    go = visits > b
                    yield pd.DataFrame({"band": [top_band[b]], "qids": [qid[go].tobytes()], "queries": [q[go].tobytes()], "floor": [best.floor[go].tobytes()]})

    asked = vectors.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    visits = asked.mapInPandas(visit, "band int, qids binary, queries binary, floor binary")

    def match(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis_ = shared.value[2]
        for pdf in it:
            for row in pdf.itertuples():
                qid, floor = np.frombuffer(row.qids, np.int64), np.frombuffer(row.floor)
                best = _Best(len(qid), k)
                search_block(np.frombuffer(row.queries, np.int64).reshape(-1, width), qid, floor, np.frombuffer(row.block, np.int64).reshape(-1, width), np.frombuffer(row.ids, np.int64), basis_, best)
                yield pd.DataFrame({"query_id": qid[best.q], "vec_id": best.id, "score": best.score})

    found = visits.join(blocks, "band").mapInPandas(match, schema)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
