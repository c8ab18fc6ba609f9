"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into partitions, correlated bits together. If two fingerprints differ in at most
t bits, then for any thresholds t_i >= -1 with sum(t_i + 1) = t + 1 they differ in at most t_i bits of some partition i
(-1: a partition that is not probed). Each fingerprint gets the thresholds that make the fewest estimated candidates,
by dynamic programming over the partitions; it probes the partitions' buckets accordingly and every candidate is
verified on all bits. Crowded buckets are cut again by their remaining bits, on the same principle, until they are small:
a bucket that fixes b bits holds at most 2^(64-b) different fingerprints. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER_BYTES, arrow_rows, batches, blob, cut, narrow, runs, strings_as_bytes, unblob
from lattica.llm.components import connected_components, least_reached

BITS = 64
_FULL = (1 << BITS) - 1


def shingles(text: bytes | None, k: int) -> list[bytes]:
    """Space-joined runs of k words of the lower-cased text, repeats included; fewer words: the whole sequence."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprint(grams: list[bytes], seed: int = 42) -> int:
    """The majority of each bit of the shingles' XXH64, unsigned; no shingles: zero."""
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(grams)
    for at in range(0, n, 1 << 16):  # a very long text goes by in parts
        h = np.fromiter((digest(g, seed) for g in grams[at : at + (1 << 16)]), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number. A null or wordless text has fingerprint zero."""
    rows = docs.select(key, text)
    schema = pa.schema([pa.field("key", pa.int64()), pa.field("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 23):
            fps = np.array([fingerprint(shingles(t, k)) for t in strings_as_bytes(batch.column(1))], np.uint64)
            yield arrow_rows(schema, (batch.column(0).cast(pa.int64()), fps.view(np.int64)))

    return narrow(rows).mapInArrow(run, "key long, fp long").select(F.col("key").alias(key), "fp")


def bit_groups(fps: DataFrame, groups: int) -> list[int]:
    """Masks of equally wide groups of bits, correlated bits together, from all fingerprints' 64 x 64 bit moments."""

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS + 1, BITS), np.int64)
        for pdf in it:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:BITS] += np.rint(bits.T @ bits).astype(np.int64)
            total[BITS] += len(pdf)
        yield pd.DataFrame({"cell": np.arange(total.size), "n": total.ravel()})

    sums = fps.select("fp").mapInPandas(moments, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    m = np.zeros((BITS + 1) * BITS)  # 4160 cells, whatever the input
    for cell, n in sums.collect():
        m[cell] = n
    m = m.reshape(BITS + 1, BITS)
    n = max(1.0, m[BITS, 0])
    mean = np.diag(m[:BITS]) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(m[:BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread)
    free, masks = list(range(BITS)), []
    for g in range(groups):
        width = BITS // groups + (g < BITS % groups)
        own = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (tie[b, own].sum(), -b)))
            free.remove(own[-1])
        masks.append(sum(1 << b for b in own))
    return masks


def allocate(cost: np.ndarray, units: int) -> np.ndarray:
    """Thresholds (rows x partitions, -1: not probed) of least summed cost with sum(t_i + 1) = units.

    cost[r, i, u]: estimated candidates of row r if partition i gets u units (threshold u - 1); cost[..., 0] is 0.
    """
    rows, parts, levels = cost.shape
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((parts, rows, units + 1), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for u in range(min(levels - 1, units) + 1):
            via = best[:, : units + 1 - u] + cost[:, i, u][:, None]
            at = slice(u, units + 1)
            less = via < new[:, at]
            new[:, at] = np.where(less, via, new[:, at])
            took[i][:, at] = np.where(less, u, took[i][:, at])
        best = new
    out, left = np.zeros((rows, parts), np.int64), np.full(rows, units)
    for i in reversed(range(parts)):
        out[:, i] = took[i][np.arange(rows), left] - 1
        left = left - took[i][np.arange(rows), left] - 0
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _split(mask: int, parts: int) -> list[int]:
    """The bits outside mask in parts groups."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in free[p::parts]) for p in range(parts) if free[p::parts]]


def _flips(mask: int, radius: int) -> np.ndarray:
    bits = [b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(bits, r)], np.uint64)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (a, b) of n rows to keep so that they still connect what all of them connect (Boruvka)."""
    part, kept = np.arange(n), []
    while True:
        pa, pb = part[a], part[b]
        live = np.flatnonzero(pa != pb)
        if not len(live):
            return np.unique(np.concatenate(kept)) if kept else live
        first = np.full(n, len(a))
        np.minimum.at(first, pa[live], live)
        np.minimum.at(first, pb[live], live)
        pick = np.unique(first[first < len(a)])
        kept.append(pick)
        part = least_reached(pa[pick], pb[pick], n)[part]


def _links(bits: int):
    """For rows sorted by bucket: links (a, b) of fingerprints that connect all that the bucket's links connect."""

    def within(fp: np.ndarray, bucket: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, a, b = len(fp), [], []
        step, live = 1, np.arange(n)
        while len(live := live[live + step < n]) and len(live := live[bucket[live] == bucket[live + step]]):
            hit = live[(np.bitwise_count(fp[live] ^ fp[live + step]) <= bits) & (probe[live] | probe[live + step])]
            a.append(hit)
            b.append(hit + step)
            step += 1
            if sum(map(len, a)) > 1 << 20:  # fold the pairs so far into one spanning forest
                x, y = np.concatenate(a), np.concatenate(b)
                keep = _forest(x, y, n)
                a, b = [x[keep]], [y[keep]]
        x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
        keep = _forest(x, y, n)
        return x[keep], y[keep]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = np.flatnonzero(changes(pdf)) + 1
            last = int(new[-1]) if len(new) else 0
            held = pdf.iloc[last:]  # the last bucket may go on in the next batch
            if last:
                yield out(pdf.iloc[:last])
        if held is not None:
            yield out(held)

    def changes(pdf: pd.DataFrame) -> np.ndarray:
        columns = [pdf[c].to_numpy() for c in ("mask", "value")]
        return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])

    def out(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = np.concatenate([[0], np.cumsum(changes(pdf))])
        fp = pdf["fp"].to_numpy(np.int64)
        a, b = within(fp.view(np.uint64), bucket, pdf["probe"].to_numpy(bool))
        return pd.DataFrame({"a": fp[a], "b": fp[b]}).drop_duplicates()

    return run


def near_links(prints: DataFrame, bits: int, partitions: int | None = None, bucket_rows: int = 2048) -> DataFrame:
    """(a, b) fingerprints that differ in bits bits or fewer, enough of them to span every group of linked ones.

    prints: different fingerprints fp. No link is lost; links that others imply may be left out.
    """
    parts, units = partitions or bits + 1, bits + 1
    fps = cut(prints.select("fp"))
    n = max(1, fps.count())
    masks = bit_groups(fps, parts)
    own = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = own.groupBy("mask", "value").agg(F.count("*").alias("n"))
    # values met once need no row of their own in the join
    crowded = own.join(sizes.where("n > 1"), ["mask", "value"])
    counts = crowded.groupBy("fp").agg(*(F.max(F.when(F.col("mask") == _signed(m), F.col("n"))).alias(f"n{i}") for i, m in enumerate(masks)))
    widths = [m.bit_count() for m in masks]

    def probes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            here = np.nan_to_num(pdf[[f"n{i}" for i in range(parts)]].to_numpy(np.float64), nan=1.0)
            cost = np.zeros((len(fp), parts, units + 1))
            around = np.ones(parts)
            for u in range(1, units + 1):
                # the value's own bucket is counted; its neighbours are taken at the mean load, plus one for each probe
                cost[:, :, u] = here + [(a - 1) * (1 + n / 2.0**w) for a, w in zip(around, widths, strict=True)]
                around = around + [float(np.prod(range(w - u + 1, w + 1)) / np.prod(range(1, u + 1))) for w in widths]
            limits = allocate(cost, units)
            for i, m in enumerate(masks):
                signed = np.int64(_signed(m))
                yield pd.DataFrame({"fp": fp.view(np.int64), "mask": signed, "value": (fp & np.uint64(m)).view(np.int64), "probe": limits[:, i] >= 0})
                for t in range(1, units):
                    wide = fp[limits[:, i] == t]
                    for flip in _flips(m, t) if len(wide) else ():
                        yield pd.DataFrame({"fp": wide.view(np.int64), "mask": signed, "value": ((wide & np.uint64(m)) ^ flip).view(np.int64), "probe": True})

    filled = fps.join(counts, "fp", "left")
    # probe rows meet the fingerprints in the bucket they probe; a row of its own bucket is both
    keyed = cut(filled.mapInPandas(probes, "fp long, mask long, value long, probe boolean"))
    found = None
    for _ in range(BITS):
        # buckets that nobody probes make no pairs, however full
        loads = keyed.groupBy("mask", "value").agg(F.count("*").alias("n"), F.max("probe").alias("p"))
        full = cut(loads.where(F.col("n") > bucket_rows).select("mask", "value", "p"))
        big = full.where("p").select("mask", "value")
        fixed = [r["mask"] for r in big.select("mask").distinct().collect()]  # a few masks, not buckets
        small = keyed if full.isEmpty() else keyed.join(full.select("mask", "value"), ["mask", "value"], "left_anti")
        # by a hash of the bucket, not by its columns: by those of the join before it, this exchange would be planned away, and the
        # join's own, once it turns into a broadcast, be read where it was written, with a bucket's rows in several tasks
        dealt = small.repartition(F.xxhash64("mask", "value")).sortWithinPartitions("mask", "value", "fp")
        links = dealt.mapInPandas(_links(bits), "a long, b long")
        found = links if found is None else found.unionAll(links)
        if not fixed:
            break
        finer = F.create_map(*(x for m in fixed for x in (F.lit(m), F.array(*(F.lit(_signed(m & _FULL | s)) for s in _split(m & _FULL, bits + 1))))))
        held = keyed.join(big, ["mask", "value"])
        # a probe row sits in a bucket whose fixed bits are not all its own: it keeps those, and adds its own of the rest
        deeper = held.withColumn("_m", F.explode(finer[F.col("mask")]))
        value = F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("_m").bitwiseXOR(F.col("mask"))))
        keyed = cut(deeper.select("fp", F.col("_m").alias("mask"), value.alias("value"), "probe"))
    return found.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row: fingerprints at bits or fewer differing bits are linked.

    component_id is the smallest key reachable over links, itself included; equal texts and all wordless or null texts
    share a fingerprint. A repeated key yields a row for each of its rows; an empty table yields none.
    """
    prints = cut(fingerprints(docs, k, key, text))
    nodes = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    classes = connected_components(near_links(nodes, bits))
    labelled = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(least, "component").select("fp", "component_id")
    out = prints.join(by_print, "fp")
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_SLACK = 1e-9  # bounds give way by this much, so that rounding loses no pair


def _missing(n: int, share: float) -> int:
    """How many of a set's n members a set may lack that holds at least share of them."""
    return n - int(np.ceil(share * n - _SLACK))


def _gram_set(raw: bytes | None, k: int) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in shingles(raw, k)), np.uint64))


def _digest(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 1)


def _parity(grams: np.ndarray) -> bytes:
    """Of each of 2^j cells, at least as many as grams, whether an odd number of grams fall in it (by their low bits)."""
    cells = max(64, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_match(x: bytes, y: bytes, n: int, m: int, similarity: float) -> bool:
    """False only if sets of n and m members are less alike than similarity: each odd cell of both takes one differing member."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) != len(q):
        p, q = (p, q) if len(p) > len(q) else (q, p)
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    most = n + m - 2 * np.ceil(similarity / (1 + similarity) * (n + m) - _SLACK)
    return int(np.bitwise_count(p ^ q).sum()) <= most


def _mixed(x: np.ndarray, shards: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(shards)).astype(np.int64)


#: Shingles are met by the upper 48 bits of their hashes; what meets by chance is told apart later.
_MET_BITS = 48


def _set_blocks(rows: DataFrame, k: int, print_k: int, similarity: float, low: int, block_bytes: int) -> DataFrame:
    """(block, lows, data): blocks of rows. data holds their keys and, of each different shingle set in the block, the digest,
    fingerprint (over print_k words; a text's of that set), size, parity and least hashes: all under low, or as many as a prefix
    holds; lows counts those that are not under low."""

    def close(part: int, nth: int, keys: list, which: list, found: dict) -> tuple:
        sets = [s for s, _, _ in found.values()]
        fps = np.array([fp for _, _, fp in found.values()], np.uint64)
        size = np.array([len(s) for s in sets], np.int32)
        met = [(s >> np.uint64(64 - _MET_BITS)).astype(np.int64) for s in sets]
        under = [int(np.searchsorted(m, low)) for m in met]
        taken = [max(u, min(len(m), _missing(len(m), similarity) + 1)) for u, m in zip(under, met, strict=True)]
        flat = np.concatenate([m[:t] for m, t in zip(met, taken, strict=True)] or [np.zeros(0, np.int64)])
        parity = np.frombuffer(b"".join(_parity(s) for s in sets), np.uint8)
        data = blob(np.array(keys, np.int64), np.array(which, np.int32), np.array(list(found), np.uint64), fps, size, np.array(taken, np.int32), np.diff(flat, prepend=0), parity)
        return (part << 24) + nth, sum(taken) - sum(under), data

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, size, keys, which, found = TaskContext.get().partitionId(), 0, 0, [], [], {}
        schema = pa.schema([("block", pa.int64()), ("rest", pa.int64()), ("data", pa.binary())])
        for batch in batches(it, block_bytes):
            for key, raw in zip(batch.column(0).cast(pa.int64()).to_pylist(), strings_as_bytes(batch.column(1)), strict=True):
                grams = _gram_set(raw, k)
                digest = _digest(grams)
                keys.append(key)
                if digest not in found:
                    found[digest] = grams, len(found), fingerprint(shingles(raw, print_k))
                which.append(found[digest][1])
                size += len(raw or b"")
                if size >= block_bytes:
                    yield arrow_rows(schema, [[x] for x in close(part, nth, keys, which, found)])
                    nth, size, keys, which, found = nth + 1, 0, [], [], {}
        if keys:
            yield arrow_rows(schema, [[x] for x in close(part, nth, keys, which, found)])

    return narrow(rows).mapInArrow(run, "block long, rest long, data binary")


class _Sets:
    """A block of _set_blocks, read back."""

    def __init__(self, data: bytes, low: int) -> None:
        self.keys, self.which, self.digest, self.fp, self.size, taken, gaps, self.parity = unblob(data)
        self.of = np.repeat(np.arange(len(taken)), taken)
        self.gram = np.cumsum(gaps)
        self.under = self.gram < low
        self.asked, self.place, self.texts = np.unique(self.gram[self.under], return_inverse=True, return_counts=True)

    def parities(self) -> list[bytes]:
        width = np.array([max(64, 1 << max(0, int(n) - 1).bit_length()) // 8 for n in self.size], np.int64)
        return [x.tobytes() for x in np.split(self.parity, np.cumsum(width)[:-1])] if len(width) else []


def _by_range(low: int, shards: int):
    """The part of the hashes under low that each asked one falls in; parts are in the order of hashes."""
    return lambda x: np.minimum((x / low * shards).astype(np.int64), shards - 1)


def _frequencies(blocks: DataFrame, low: int, shards: int, crowd: int) -> DataFrame:
    """(block, shard, met, kinds): for the hashes under low of a block, in order, 0: in one text, 1: in up to crowd, 2: in more."""
    part_of = _by_range(low, shards)

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                b = _Sets(row.data, low)
                part = part_of(b.asked)
                first = runs(part)
                cuts = zip(part[first].tolist(), np.split(b.asked, first[1:]), np.split(b.texts, first[1:]), strict=True) if len(first) else ()
                yield pd.DataFrame([(s, row.block, blob(np.diff(g, prepend=0), n.astype(np.uint32))) for s, g, n in cuts], columns=["shard", "block", "data"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked, counts = zip(*(unblob(d) for d in pdf["data"]), strict=True)
        asked = [np.cumsum(g) for g in asked]
        grams, place = np.unique(np.concatenate(asked), return_inverse=True)
        texts = np.bincount(place, np.concatenate(counts), len(grams))
        kind = (texts > 1).astype(np.uint8) + (texts > crowd)
        own = np.split(kind[place], np.cumsum([len(g) for g in asked])[:-1])
        return pd.DataFrame({"block": pdf["block"], "shard": key[0], "met": [int((x > 0).sum()) for x in own], "kinds": [blob(x) for x in own]})

    asked = blocks.select("block", "data").mapInPandas(ask, "shard int, block long, data binary")
    return asked.groupBy("shard").applyInPandas(answer, "block long, shard int, met long, kinds binary")


def _prefixes(similarity: float, low: int, shards: int):
    """Entries of the blocks' prefixes by shard. Shingles are ordered: under low those in one text, in few, in many; then the rest.

    An entry is a shingle that more than one text may have, the text's digest and its size, negative if the entry is within
    the prefix that the smaller set of an alike pair needs.
    """
    inner = 2 * similarity / (1 + similarity)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                b = _Sets(row.data, low)
                kind = np.full(len(b.gram), 3, np.int8)
                if row.answers is not None and len(b.asked):
                    kinds = [unblob(a["kinds"])[0] for a in sorted(row.answers, key=lambda a: a["shard"])]
                    kind[b.under] = np.concatenate(kinds)[b.place]
                order = np.lexsort((b.gram, kind, b.of))
                of, first = b.of[order], runs(b.of)
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                size = b.size[of].astype(np.int64)
                longest, short = (size - np.ceil(share * size - _SLACK).astype(np.int64) for share in (similarity, inner))
                kept = (rank <= longest) & (kind[order] > 0)
                gram, node = b.gram[order][kept], b.digest[of[kept]]
                signed = np.where(rank <= short, -size, size)[kept].astype(np.int32)
                shard = _mixed(gram, shards)
                by = np.lexsort((gram, shard))
                first = runs(shard[by])
                cuts = np.split(by, first[1:]) if len(first) else []
                yield pd.DataFrame([(int(shard[c[0]]), blob(np.diff(gram[c], prepend=0), node[c], signed[c])) for c in cuts], columns=["shard", "data"])

    return run


def _prefix_links(shard_rows: pd.DataFrame, similarity: float, crowd: int) -> pd.DataFrame:
    """Candidates of a shard of prefixes: all pairs of a shingle's texts; of more than crowd texts a chain, marked as such.

    The smaller set of a pair of candidates has the shingle in its short prefix, and its size is at least similarity of
    the other's. By size, every text is chained to the one with a short prefix before it: sizes between those of a pair are
    nearer to each other than its own, so the chains connect all that the pairs would.
    """
    gaps, nodes, sizes = zip(*(unblob(d) for d in shard_rows["data"]), strict=True)
    gram, node, size = np.concatenate([np.cumsum(g) for g in gaps]), np.concatenate(nodes).view(np.int64), np.concatenate(sizes)
    short, size = size < 0, np.abs(size).astype(np.int64)
    order = np.lexsort((node, size, gram))
    gram, node, size, short = gram[order], node[order], size[order], short[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
    gram, node, size, short = gram[new], node[new], size[new], short[new]
    first = runs(gram)
    load = np.diff(np.concatenate([first, [len(gram)]]))
    start, crowded = np.repeat(first, load), np.repeat(load > crowd, load)
    at = np.arange(len(gram))
    last = np.maximum.accumulate(np.where(short, at, -1))
    last = np.concatenate([[-1], last[:-1]])
    chained = np.flatnonzero(crowded & (last >= start))
    chained = chained[size[last[chained]] >= similarity * size[chained] - _SLACK]
    x, y = [last[chained]], [chained]
    live = np.flatnonzero(~crowded)
    for step in range(1, crowd):
        live = live[live - step >= start[live]]
        hit = live[short[live - step] & (size[live - step] >= similarity * size[live] - _SLACK)]
        x.append(hit - step)
        y.append(hit)
    a, b = node[np.concatenate(x)], node[np.concatenate(y)]
    out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "chain": np.arange(len(a)) < len(chained)})
    return out.sort_values("chain", ascending=False).drop_duplicates(["a", "b"])


def _true_links(node: np.ndarray, sets: list[np.ndarray], half: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of alike sets that connect all alike sets; only pairs of both halves count, if there are two.

    A set's overlaps with all others are counted over the lists of its members; it is passed over if its class already
    holds every set of a fitting size.
    """
    m = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, node, half = [sets[i] for i in order], node[order], half[order]
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(m, dtype=np.int32), size)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    by_gram = np.argsort(gram, kind="stable")
    lists, ends = of[by_gram], np.concatenate([[0], np.cumsum(np.bincount(gram))])
    cuts = np.concatenate([[0], np.cumsum(size)])
    two = half.min() != half.max()
    part, a, b = np.arange(m), [], []
    for i in range(m):
        # larger sets only: a smaller one has met this set already
        stop = int(np.searchsorted(size, size[i] / similarity + 1e-6, side="right"))
        open_ = part[i + 1 : stop] != part[i]
        if two:
            open_ &= half[i + 1 : stop] != half[i]
        if not open_.any():
            continue
        own = gram[cuts[i] : cuts[i + 1]]
        both = np.zeros(m, np.int64)
        for at in range(0, len(own), 1 << 12):
            both += np.bincount(np.concatenate([lists[ends[g] : ends[g + 1]] for g in own[at : at + (1 << 12)]]), minlength=m)
        own_both = both[i + 1 : stop]
        for j in np.flatnonzero(open_ & (own_both >= similarity * (size[i] + size[i + 1 : stop] - own_both))) + i + 1:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                a.append(node[i])
                b.append(node[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _kin(nodes: DataFrame, bits: int) -> DataFrame:
    """(digest, kin): kin is the same for the sets whose fingerprints fp are linked at bits or fewer differing bits."""
    linked = connected_components(near_links(nodes.select("fp").distinct(), bits)).withColumnRenamed("node", "fp")
    return nodes.select("digest", "fp").join(linked, "fp", "left").select("digest", F.coalesce("component", "fp").alias("kin"))


def near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", print_k: int = 3, bits: int = 3, crowd: int = 16, share: float = 0.35, block_bytes: int = 8 << 20, shard_entries: int = 1_000_000, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(key, component_id): documents linked if their sets of k-word shingles have a Jaccard similarity of at least similarity.

    Candidates are the texts whose fingerprints over print_k words are linked at bits or fewer differing bits (near_links:
    generalised pigeonhole, allocated thresholds). Alike texts may have fingerprints further apart: pairs that no
    fingerprints link are candidates by their shingles. All that candidates connect is checked exactly.

    No link is lost. For the pairs beyond the fingerprints, shingles are ordered, rare ones first; of two sets this alike,
    the first shingle that they share lies among the first of each (prefix filter). How many texts hold a shingle is counted
    for the lowest share of all hashes, from which prefixes are taken; those that one text holds link nothing and are not
    sent on. Pairs of texts that meet in a shingle pass two bounds, on sizes and on parities of cells, which no true pair
    fails; of a crowded shingle's texts only chains are taken, none of which is dropped. What these candidates connect is
    compared whole, set by set: in one task, or where the sets exceed chunk_bytes in chunks of which every two meet. Equal
    sets are one node, known by a 64-bit hash. Wordless and null texts are equal to each other; rows without a key are left
    out.
    """
    rows = docs.where(F.col(key).isNotNull()).select(key, text)
    low = int(share * (1 << _MET_BITS))
    blocks = cut(_set_blocks(rows, k, print_k, similarity, low, block_bytes))

    def prints_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["data"]:
                b = _Sets(data, low)
                yield pd.DataFrame({"key": b.keys, "digest": b.digest[b.which].view(np.int64)})

    def nodes_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["data"]:
                b = _Sets(data, low)
                least = np.full(len(b.digest), np.iinfo(np.int64).max)
                np.minimum.at(least, b.which, b.keys)
                yield pd.DataFrame({"digest": b.digest.view(np.int64), "fp": b.fp.view(np.int64), "least": least, "n": b.size, "parity": b.parities()})

    prints = blocks.select("data").mapInPandas(prints_of, "key long, digest long")
    nodes = blocks.select("data").mapInPandas(nodes_of, "digest long, fp long, least long, n int, parity binary")
    # one size and parity to a digest, up to equal hashes; of the fingerprints, which repeats may tell apart, any one will do
    nodes = cut(nodes.groupBy("digest").agg(F.min("fp").alias("fp"), F.min("least").alias("least"), F.max("n").alias("n"), F.max("parity").alias("parity")))
    kin = cut(_kin(nodes, bits))
    several = kin.groupBy("kin").agg(F.min("digest").alias("a"), F.count("*").alias("n")).where("n > 1")
    akin = kin.join(several, "kin").select("a", F.col("digest").alias("b"))
    held, rest = blocks.agg(F.sum(F.octet_length("data")), F.sum("rest")).first()
    shards = 1 + int(held or 0) // (5 * shard_entries)  # five bytes a hash or so
    kinds = cut(_frequencies(blocks, low, shards, crowd))
    entries = (kinds.agg(F.sum("met")).first()[0] or 0) + (rest or 0)
    by_block = kinds.groupBy("block").agg(F.collect_list(F.struct("shard", "kinds")).alias("answers"))
    dealt = blocks.select("block", "data").join(by_block, "block", "left").mapInPandas(_prefixes(similarity, low, 1 + entries // shard_entries), "shard int, data binary")
    met = dealt.groupBy("shard").applyInPandas(lambda pdf: _prefix_links(pdf, similarity, crowd), "a long, b long, chain boolean")
    met = cut(met.groupBy("a", "b").agg(F.max("chain").alias("chain")))

    def bounded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fits = [_may_match(x, y, n, m, similarity) for x, y, n, m in zip(pdf["x"], pdf["y"], pdf["n"], pdf["m"], strict=True)]
            yield pdf.loc[fits, ["a", "b"]]

    about = nodes.join(kin, "digest")
    ends = [about.select(F.col("digest").alias(c), F.col("n").alias(n), F.col("parity").alias(p), F.col("kin").alias(f"kin_{c}")) for c, n, p in (("a", "n", "x"), ("b", "m", "y"))]
    # what fingerprints link is compared anyway
    beyond = met.where("not chain").join(ends[0], "a").join(ends[1], "b").where("kin_a <> kin_b")
    likely = beyond.select("a", "b", "n", "m", "x", "y").mapInPandas(bounded, "a long, b long")
    groups = connected_components(akin.unionAll(met.where("chain").select("a", "b")).unionAll(likely))
    sized = cut(nodes.select("digest", "n", "least").join(groups.withColumnRenamed("node", "digest"), "digest"))
    chunks = sized.groupBy("component").agg(F.ceil(F.sum("n") * 8 / chunk_bytes).alias("c"))
    sized = sized.join(chunks, "component")
    wanted = cut(sized.select(F.col("digest").alias("node"), F.col("least").alias(key), "component", "c"))
    sets = pa.schema([("digest", pa.int64()), ("grams", pa.binary())])

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 22):
            found = [_gram_set(raw, k) for raw in strings_as_bytes(batch.column(1))]
            yield arrow_rows(sets, (np.array([_digest(s) for s in found], np.uint64).view(np.int64), [s.tobytes() for s in found]))

    # a key may have several texts, and rows: those of another digest fall out, the others count once
    held = rows.join(wanted.select(key).distinct(), key, "left_semi").mapInArrow(gather, "digest long, grams binary")
    placed = held.join(wanted.drop(key), F.col("digest") == F.col("node")).drop("digest")
    own = F.pmod(F.xxhash64("node"), F.col("c"))
    each = placed.withColumn("_h", own).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)))
    two = F.least("_h", "_j") * F.col("c") + F.greatest("_h", "_j")
    half = F.when(F.col("_h") > F.col("_j"), 1).otherwise(0)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        a, b = _true_links(pdf["node"].to_numpy(np.int64), [np.frombuffer(g, np.uint64) for g in pdf["grams"]], pdf["half"].to_numpy(), similarity)
        return pd.DataFrame({"a": a, "b": b})

    grouped = each.select("component", two.alias("two"), half.alias("half"), "node", "grams").groupBy("component", "two")
    classes = connected_components(grouped.applyInPandas(compared, "a long, b long"))
    labelled = cut(nodes.select("digest", "least").join(classes.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_digest = labelled.join(least, "component").select("digest", "component_id")
    return prints.join(by_digest, "digest").select(F.col("key").alias(key), "component_id")


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class of near copies, the one with the smallest key. Rows without a key all stay."""
    classes = cut(near_copies(docs, k, similarity, key, text))
    stay = classes.where(F.col(key) == F.col("component_id")).select(key).distinct()
    out = docs.join(stay, key, "left_semi").select(docs.columns)
    if classes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        out = out.dropDuplicates([key])
    return out.unionAll(docs.where(F.col(key).isNull()))
