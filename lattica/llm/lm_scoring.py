"""N-gram scoring with an Elias-Fano trie of order three.

Tokens are words and one end mark a document. The model interpolates absolutely discounted counts, D = 3/4:

    p(w | u v) = q(u v, w) + b(u v) p(w | v),   q(u v, w) = (c(u v w) - D) / c(u v),   b(u v) = 1 - sum of q(u v, .)
    p(w | v)   = q(v, w) + b(v) p(w),           q(v, w) = (c(v w) - D) / c(v),         b(v) = 1 - sum of q(v, .)
    p(w)       = (c(w) + 1/2) / (N + 1/2 (V + 1))

over all n-grams met min_count times or more in the training texts (those met once count by default). q and b are
quantised to a byte each, and each b is taken from the quantised q, so that a context's probabilities sum to one up to the
quantisation of b. A document starts in the context of two end marks. A context that was not met says nothing: b is one.

The trie is cut by its first word over the tasks of the cluster; a frequent first word over several parts by the second,
and a pair of two frequent words again by the third. Each task builds its part in compact, anonymously memory-mapped
levels: the first words; their successors' ids and, under each, the ids of its successors, all as monotone sequences in
Elias-Fano form, with pointers between the levels; probabilities as bytes. A level is one monotone sequence because each
context's ids start from the last value of the context before it. Lookups read the Elias-Fano bits in place: an id, taken
relative to its context, is searched among the values that share its high bits, and counts if it falls within the context's
pointers. Nothing is decoded whole.

Documents travel as blocks: a block asks once for each of its different n-grams, and gets back one byte for each level.
Nothing is broadcast, and no task holds more than blocks and parts of bounded size. Frequent words have small ids, so that
n-grams take few bytes on the way.

A word is known by its 64-bit hash; two of n words share one with probability below n^2 / 2^65.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER_BYTES, blob, cut, narrow, runs, strings_as_bytes, unblob

DISCOUNT = 0.75
_LOWEST = -8.0  # of a quantised log10 probability
_LEAST_BACKOFF = -5.0


def quantise(p: np.ndarray) -> np.ndarray:
    """A byte from 1 to 255 for a probability, evenly in its logarithm; 0 is kept for n-grams that are not in the trie."""
    return np.clip(np.rint((np.log10(p) - _LOWEST) / -_LOWEST * 254), 0, 254).astype(np.uint8) + np.uint8(1)


def quantise_backoff(b: np.ndarray) -> np.ndarray:
    """A byte for the weight of the shorter context; 255 is one."""
    return np.clip(np.rint((np.log10(np.maximum(b, 10**_LEAST_BACKOFF)) / -_LEAST_BACKOFF + 1) * 255), 0, 255).astype(np.uint8)


#: The probability of each code, and the weight of each.
VALUES = np.concatenate([[0.0], 10 ** (_LOWEST * (1 - np.arange(255) / 254))])
BACKOFFS = 10 ** (_LEAST_BACKOFF * (1 - np.arange(256) / 255))


def _mapped(x: np.ndarray) -> np.ndarray:
    """x in an anonymous mapping: a store that executors share cannot be mapped, and a local folder is not to be relied on."""
    memory = mmap.mmap(-1, max(8, x.nbytes))
    out = np.frombuffer(memory, x.dtype, len(x))
    out[:] = x
    return out


#: The place of the r-th set bit of each byte, and masks of single bytes.
_IN_BYTE = np.array([[[i for i in range(8) if x >> i & 1][r] if r < x.bit_count() else 0 for r in range(8)] for x in range(256)], np.uint8)
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th set bit (from 0) of each word: its byte by the sums of all bytes at once, then a table."""
    x = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + (x >> np.uint64(2) & np.uint64(0x3333333333333333))
    x = (x + (x >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte i: the ones up to it
    rank = rank.astype(np.uint64)
    place = np.bitwise_count((rank * _ONES | _TOPS) - x & _TOPS).astype(np.uint64) * np.uint64(8)
    rank -= (x << np.uint64(8)) >> place & np.uint64(255)
    return place.astype(np.int64) + _IN_BYTE[(word >> place & np.uint64(255)).astype(np.intp), rank.astype(np.intp)]


class EliasFano:
    """A monotone sequence: low bits packed, high bits as gaps in unary with the count of ones before each word of 64 bits."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.low_bits = low = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        high = (v >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(-(-((int(high[-1]) if n else 0) + n + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = _mapped(np.packbits(bits, bitorder="little").view(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        self.ones = _mapped(ones.astype(np.int32 if n < 1 << 31 else np.int64))
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        packed = []
        for at in range(0, n, 1 << 19):  # a multiple of 64, so that parts join at whole words
            part = v[at : at + (1 << 19)]
            lows = ((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(lows.ravel(), bitorder="little"))
        flat = np.concatenate([*packed, np.zeros(16, np.uint8)])
        self.low = _mapped(flat[: len(flat) // 8 * 8].view(np.uint64))

    @property
    def nbytes(self) -> int:
        return self.high.nbytes + self.ones.nbytes + self.zeros.nbytes + self.low.nbytes

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        after = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (((self.low[word] >> shift) | after) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self._lows(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: the ones before the high-th zero."""
        zeros = self.zeros
        nth = np.clip(high - 1, 0, max(0, int(zeros[-1]) - 1))
        word = np.searchsorted(zeros, nth, side="right") - 1
        place = word * 64 + _select(~self.high[word], nth - zeros[word])
        out = np.minimum(place - nth, self.n)
        return np.where(high <= 0, 0, np.where(high > zeros[-1], self.n, out))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value that is not smaller, by halving among those that share the high part, and whether
        it is equal."""
        high, low = value >> self.low_bits, value & ((1 << self.low_bits) - 1)
        first, end = self._before(high), self._before(high + 1)
        last = end.copy()
        while len(live := np.flatnonzero(first < last)):
            middle = (first[live] + last[live]) >> 1
            less = self._lows(middle) < low[live]
            first[live] = np.where(less, middle + 1, first[live])
            last[live] = np.where(less, last[live], middle)
        equal = first < end
        equal[equal] = self._lows(first[equal]) == low[equal]
        return first, equal

    def values(self) -> np.ndarray:
        """The whole sequence."""
        return self.access(np.arange(self.n))


class _Level:
    """The successors of contexts 0 to n - 1: ids from 1, sorted by context and id, one monotone sequence with pointers."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, contexts: int, code: np.ndarray) -> None:
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(np.bincount(context, minlength=contexts))]))
        first = runs(context)
        top = np.cumsum(successor[np.append(first[1:], len(context)) - 1]) if len(first) else np.zeros(0, np.int64)
        start = np.concatenate([[0], top[:-1]]) if len(first) else top
        self.ids = EliasFano(successor + np.repeat(start, np.diff(np.append(first, len(context)))))
        self.code = _mapped(code)

    @property
    def nbytes(self) -> int:
        return self.pointers.nbytes + self.ids.nbytes + self.code.nbytes

    def search(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The successor's place in the level, -1 if the context (-1: none) does not hold it. Contexts come in runs."""
        out = np.full(len(context), -1, np.int64)
        live = np.flatnonzero((context >= 0) & (successor > 0))
        at = runs(context[live])
        of, each = context[live[at]], np.diff(np.append(at, len(live)))
        begin, end = self.pointers.access(of), self.pointers.access(of + 1)
        base = np.zeros(len(of), np.int64)
        base[begin > 0] = self.ids.access(begin[begin > 0] - 1)
        place, equal = self.ids.find(np.repeat(base, each) + successor[live])
        equal &= place < np.repeat(end, each)
        out[live[equal]] = place[equal]
        return out


class TriePart:
    """Triples of some first words: codes of pairs and triples, backoffs of first words and pairs."""

    def __init__(self, first: np.ndarray, pair_of: np.ndarray, second: np.ndarray, triple_of: np.ndarray, third: np.ndarray, pair_code: np.ndarray, code: np.ndarray, first_backoff: np.ndarray, pair_backoff: np.ndarray) -> None:
        """first: sorted words; pair_of: places in first, and second: sorted pairs; triple_of: places of pairs, and third."""
        self.first = EliasFano(first)
        self.pairs = _Level(pair_of, second, len(first), pair_code)
        self.triples = _Level(triple_of, third, len(second), code)
        self.first_backoff, self.pair_backoff = _mapped(first_backoff), _mapped(pair_backoff)

    @property
    def nbytes(self) -> int:
        return self.first.nbytes + self.pairs.nbytes + self.triples.nbytes + self.first_backoff.nbytes + self.pair_backoff.nbytes

    def search_first(self, word: np.ndarray) -> np.ndarray:
        place, equal = self.first.find(word)
        return np.where(equal, place, -1)

    @staticmethod
    def _read(codes: np.ndarray, place: np.ndarray, none: int) -> np.ndarray:
        return np.where(place >= 0, codes[np.maximum(place, 0)], none).astype(np.uint8) if len(codes) else np.full(len(place), none, np.uint8)

    def answer(self, first: np.ndarray, pair_of: np.ndarray, second: np.ndarray, triple_of: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, ...]:
        """Backoffs of the first words, codes and backoffs of the pairs, codes of the triples; places are among those asked."""
        one = self.search_first(first)
        two = self.pairs.search(one[pair_of], second)
        three = self.triples.search(two[triple_of], third)
        return self._read(self.first_backoff, one, 255), self._read(self.pairs.code, two, 0), self._read(self.pair_backoff, two, 255), self._read(self.triples.code, three, 0)


def encode_blocks(docs: DataFrame, training: Column, block_bytes: int) -> DataFrame:
    """(block, n_words, n_tokens, docs, end, words): blocks of documents; words holds the different words' hashes, sorted, and
    training counts, end the end mark's place among them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce("text", F.lit("")).alias("text"))
    digest = xxhash.xxh64_intdigest

    def close(part: int, nth: int, ids: list, held: list, tokens: list, lengths: list, vocabulary: dict) -> pd.DataFrame:
        hashes = np.fromiter((digest(w) for w in vocabulary), np.uint64, len(vocabulary))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        flat = place[np.fromiter((i for t in tokens for i in t), np.int32, sum(lengths))]
        of = np.repeat(np.array(held, bool), lengths)
        counts = np.bincount(flat[of], minlength=len(order)).astype(np.uint32)
        # frequent words get small numbers in the stream
        by_use = np.argsort(-np.bincount(flat, minlength=len(order)), kind="stable").astype(np.int32)
        number = np.empty_like(by_use)
        number[by_use] = np.arange(len(order), dtype=np.int32)
        known = np.array([i is not None for i in ids])
        return pd.DataFrame(
            {
                "block": [(part << 24) + nth],
                "n_words": [len(order)],
                "n_tokens": [len(flat)],
                "docs": [blob(np.array([i or 0 for i in ids], np.int64), np.array(held, np.uint8) + 2 * known.astype(np.uint8), np.array(lengths, np.int32), number[flat], by_use)],
                "end": [int(place[0])],
                "words": [blob(hashes[order], counts)],
            }
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, size = TaskContext.get().partitionId(), 0, 0
        ids, held, tokens, lengths, vocabulary = [], [], [], [], {b"": 0}
        for batch in it:
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings_as_bytes(batch.column(2)), strict=True):
                words = text.translate(LOWER_BYTES).split()
                words.append(b"")
                tokens.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
                ids.append(i)
                held.append(t)
                lengths.append(len(words))
                size += len(text)
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pandas(close(part, nth, ids, held, tokens, lengths, vocabulary), preserve_index=False)
                    nth, size = nth + 1, 0
                    ids, held, tokens, lengths, vocabulary = [], [], [], [], {b"": 0}
        if ids:
            yield pa.RecordBatch.from_pandas(close(part, nth, ids, held, tokens, lengths, vocabulary), preserve_index=False)

    return narrow(rows).mapInArrow(run, "block long, n_words long, n_tokens long, docs binary, end long, words binary")


def _shards_of(x: np.ndarray, shards: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, order: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each shard that has some; order sorts the rows by shard."""
    own = shard[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return dict(zip(own[first].tolist(), np.split(order, first[1:]), strict=True)) if len(own) else {}


def _word_requests(shards: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                hashes, counts = unblob(row.words)
                shard = _shards_of(hashes, shards)
                parts = _by_shard(shard, np.argsort(shard, kind="stable"))
                yield pd.DataFrame([(s, row.block, blob(hashes[p], counts[p], np.diff(p, prepend=0))) for s, p in parts.items()], columns=["shard", "block", "data"])

    return run


def _word_answers(shards: int):
    """For a shard's requests: each word's count over all blocks, and its id (from 1, frequent ones first; 0: not in training).

    The r-th word of shard s has id r * shards + s + 1, so ids are about the ranks of all words by frequency.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, counts, gaps = zip(*(unblob(b) for b in pdf["data"]), strict=True)
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        ids = np.where(total > 0, rank * shards + key[0] + 1, 0)
        found = np.split(place, np.cumsum([len(h) for h in hashes])[:-1])
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame(
            {
                "block": pdf["block"],
                "shard": key[0],
                "data": [blob(total[f], ids[f], g) for f, g in zip(found, gaps, strict=True)],
                "tokens": np.where(first, total.sum(), 0),
                "words": np.where(first, (total > 0).sum(), 0),
                "most": np.where(first, ids.max(), 0),
            }
        )

    return run


def _hash_of(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) & np.uint64((1 << 62) - 1)


class _Block:
    """A block's documents, the different n-grams that they ask for, and where each shard's share of them stands.

    Entries are triples (a, b, c) of ids with a known; b = 0 asks for a's backoff only, c = 0 for the pair (a, b) only.
    A first word met more than hot times has several parts, and its backoff is asked in each; so has a pair of two such words.
    """

    def __init__(self, row, id_bits: int, hot: int, shards: int) -> None:
        total, word = np.zeros((2, row.n_words), np.int64)
        for answer in row.answers:
            own_total, own_word, gaps = unblob(answer)
            own = np.cumsum(gaps)  # the shard's words among the block's
            total[own], word[own] = own_total, own_word
        self.doc_ids, flags, self.lengths, stream, by_use = unblob(row.docs)
        self.training, self.known = (flags & 1).astype(bool), flags >= 2
        tokens = by_use[stream]
        self.total = total[tokens]
        self._triples(word, tokens, row.end, id_bits)
        self._deal(word, total, word[row.end], hot, shards)

    def _triples(self, word: np.ndarray, tokens: np.ndarray, end: int, id_bits: int) -> None:
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        before, before2 = np.empty_like(tokens), np.empty_like(tokens)
        before[1:], before[:1] = tokens[:-1], end  # the token before a document is the end mark of the last one
        before2[2:], before2[:2] = tokens[:-2], end
        before2[starts] = end
        n = len(tokens)
        # after a document's last token one more pair is asked for: that token's own
        a, b, c = word[np.append(before2, before[ends - 1])], word[np.append(before, tokens[ends - 1])], word[np.append(tokens, np.full(len(ends), end))]
        c[n:] = 0
        self.with_pair = np.arange(1, n + 1)
        self.with_pair[ends - 1] = n + np.arange(len(ends))  # the entry whose pair is (before, token)
        learn = np.append(np.repeat(self.training, self.lengths), self.training)
        live = np.flatnonzero(a > 0)
        c[b == 0] = 0
        pairs, pair = np.unique((a[live] << id_bits) | b[live], return_inverse=True)
        triples, place = np.unique((pair << id_bits) | c[live], return_inverse=True)
        self.at = np.full(len(a), -1, np.int64)
        self.at[live] = place
        self.count = np.bincount(place[learn[live]], minlength=len(triples))
        self.pair, self.c = triples >> id_bits, triples & ((1 << id_bits) - 1)
        self.a, self.b = pairs >> id_bits, pairs & ((1 << id_bits) - 1)
        self.id_bits = id_bits

    def _deal(self, word: np.ndarray, total: np.ndarray, end: int, hot: int, shards: int) -> None:
        by_id = np.argsort(word, kind="stable")
        total_of = lambda ids: np.where(ids > 0, total[by_id[np.minimum(np.searchsorted(word[by_id], ids), len(by_id) - 1)]], 0)
        many = 1 + total_of(self.a) // hot  # parts of the first word
        wide = np.where(self.b > 0, 1 + np.minimum(total_of(self.a), total_of(self.b)) // hot, 1)  # of them, the pair's
        # such a pair's own count does not follow from its triples in any one part
        self.split = (wide > 1) | ((self.a == end) & (self.b == end))
        first = runs(self.a)
        self.first = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(self.a))))
        self.many = many[first]
        home = (_hash_of(self.b) % many.astype(np.uint64)).astype(np.int64)
        p = self.pair
        part = (home[p] + (_hash_of(self.c) % wide[p].astype(np.uint64)).astype(np.int64)) % many[p]
        # pairs over several parts are asked for in each of them, with their own count in the first; hot first words in every part
        over = np.flatnonzero(wide > 1)
        kept = np.flatnonzero(~((self.c == 0) & (wide[p] > 1)) & ~((self.b[p] == 0) & (many[p] > 1)))
        of_over = np.repeat(over, wide[over])
        nth = np.arange(len(of_over)) - np.repeat(np.cumsum(wide[over]) - wide[over], wide[over])
        own = np.bincount(p, self.count * ~((self.a[p] == end) & (self.b[p] == end) & (self.c > 0)), len(self.a)).astype(np.int64)
        hot_first = np.flatnonzero(self.many > 1)
        of_hot = np.repeat(hot_first, self.many[hot_first])
        nth_hot = np.arange(len(of_hot)) - np.repeat(np.cumsum(self.many[hot_first]) - self.many[hot_first], self.many[hot_first])
        none = lambda x: np.full(len(x), -1, np.int64)
        self.asked = {
            "first": np.concatenate([self.first[p[kept]], self.first[of_over], of_hot]),
            "pair": np.concatenate([p[kept], of_over, none(of_hot)]),
            "triple": np.concatenate([kept, none(of_over), none(of_hot)]),
            "count": np.concatenate([self.count[kept], np.where(nth == 0, own[of_over], 0), np.zeros(len(of_hot), np.int64)]),
        }
        words = self.a[first]
        spot = np.concatenate([part[kept], (home[of_over] + nth) % many[of_over], nth_hot])
        if len(of_over) or len(of_hot):  # in order again, so that each word and pair is one run of a request
            pair = self.asked["pair"]
            order = np.lexsort((self.asked["triple"], np.where(pair >= 0, 2 * pair + 1, 2 * first[self.asked["first"]])))
            self.asked, spot = {k: x[order] for k, x in self.asked.items()}, spot[order]
        shard = _shards_of(words[self.asked["first"]] * np.int64(1 << 20) + spot, shards)
        self.parts = _by_shard(shard, np.argsort(shard, kind="stable"))
        self.words = words

    def request(self, own: np.ndarray) -> bytes:
        """The entries asked for at these places, as runs of pairs within runs of first words."""
        first, pair, triple = (self.asked[x][own] for x in ("first", "pair", "triple"))
        at = runs(first * np.int64(len(self.a) + 1) + pair)
        top = runs(first[at])
        second = np.where(pair[at] >= 0, self.b[pair[at]], 0)
        third = np.where(triple >= 0, self.c[triple], 0)
        flag = np.where(pair[at] >= 0, self.split[pair[at]], False)
        return blob(
            np.diff(self.words[first[at[top]]], prepend=0), np.diff(np.append(top, len(at))).astype(np.int32),
            second, np.diff(np.append(at, len(first))).astype(np.int32), third, self.asked["count"][own].astype(np.uint32),
            np.flatnonzero(flag).astype(np.int32), np.flatnonzero(self.many[first[at[top]]] > 1).astype(np.int32),
        )

    def probabilities(self, answers, p1: np.ndarray) -> np.ndarray:
        """Each token's probability, from the shards' answers and its own without context."""
        if not len(self.c):
            return p1
        triple_q = np.zeros(len(self.c))
        pair_q = np.zeros(len(self.a))
        pair_back, first_back = np.ones(len(self.a)), np.ones(len(self.words))
        pair_sum, first_sum = np.zeros((2, len(self.a))), np.zeros((2, len(self.words)))
        for x in answers:
            own = self.parts[x["shard"]]
            first, pair, triple = (self.asked[k][own] for k in ("first", "pair", "triple"))
            at = runs(first * np.int64(len(self.a) + 1) + pair)
            top = runs(first[at])
            one_b, two_q, two_b, three_q, pair_n, first_n = unblob(x["data"])
            f, p = first[at[top]], pair[at]
            hot, split = self.many[f] > 1, np.where(p >= 0, self.split[p], False)
            first_back[f[~hot]] = BACKOFFS[one_b[~hot]]
            np.add.at(first_sum, (slice(None), f[hot]), np.array([first_n, first_n * BACKOFFS[one_b[hot]]]))
            n_of = np.ones(len(f))
            n_of[hot] = first_n
            plain = (p >= 0) & ~split
            pair_back[p[plain]] = BACKOFFS[two_b[plain]]
            np.add.at(pair_sum, (slice(None), p[split]), np.array([pair_n, pair_n * BACKOFFS[two_b[split]]]))
            of_first = np.repeat(np.arange(len(f)), np.diff(np.append(top, len(at))))
            real = p >= 0
            # codes are relative to the part; where there are several parts, the part's share of the count comes in below
            pair_q[p[real]] += VALUES[two_q[real]] * np.where(hot[of_first[real]], n_of[of_first[real]], 1)
            m = np.ones(len(at))
            m[split] = pair_n
            of_pair = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(first))))
            t = triple >= 0
            triple_q[triple[t]] += VALUES[three_q[t]] * m[of_pair[t]]
        hot = self.many > 1
        first_back[hot] = np.where(first_sum[0, hot] > 0, first_sum[1, hot] / np.maximum(1, first_sum[0, hot]), 1)
        pair_q = np.where(hot[self.first], pair_q / np.maximum(1, first_sum[0, self.first]), pair_q)
        pair_back[self.split] = np.where(pair_sum[0, self.split] > 0, pair_sum[1, self.split] / np.maximum(1, pair_sum[0, self.split]), 1)
        triple_q = np.where(self.split[self.pair], triple_q / np.maximum(1, pair_sum[0, self.pair]), triple_q)
        n = len(p1)
        two, three = self.at[self.with_pair], self.at[:n]
        pair, p2 = self.pair[np.maximum(two, 0)], p1.copy()
        live = two >= 0
        p2[live] = pair_q[pair[live]] + first_back[self.first[pair[live]]] * p1[live]
        p3 = p2.copy()
        live = three >= 0
        p3[live] = triple_q[three[live]] + pair_back[self.pair[three[live]]] * p2[live]
        return p3


def _requests(id_bits: int, hot: int, shards: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                block = _Block(row, id_bits, hot, shards)
                if block.parts:
                    yield pd.DataFrame([(s, row.block, block.request(own)) for s, own in block.parts.items()], columns=["shard", "block", "data"])

    return run


def build_part(first: np.ndarray, second: np.ndarray, split: np.ndarray, pair: np.ndarray, third: np.ndarray, count: np.ndarray, min_count: int) -> tuple[TriePart, np.ndarray, np.ndarray]:
    """The trie of a part, and how often its pairs and first words are contexts.

    first, second: different pairs, sorted, with split if only entries with third 0 count for the pair itself; pair, third:
    different triples, sorted, with their counts.
    """
    context = np.bincount(pair, count * (third > 0), len(first))
    own = np.bincount(pair, count * ((third == 0) | ~split[pair]), len(first)) * (second > 0)
    words = first[runs(first)]
    place = np.searchsorted(words, first)
    of_word = np.bincount(place, own, len(words))
    in_trie = (second > 0) & ((own > 0) | (context > 0))
    kept = (third > 0) & (count >= min_count)
    code = quantise((count[kept] - DISCOUNT) / context[pair[kept]])
    pair_code = np.zeros(len(first), np.uint8)
    told = own >= max(1, min_count)
    pair_code[told] = quantise((own[told] - DISCOUNT) / of_word[place[told]])
    pair_back = quantise_backoff(1 - np.bincount(pair[kept], VALUES[code], len(first)))
    first_back = quantise_backoff(1 - np.bincount(place, VALUES[pair_code], len(words)))
    met = np.flatnonzero(np.bincount(place[in_trie], minlength=len(words)))
    in_words = np.cumsum(np.bincount(met, minlength=len(words))) - 1
    in_pairs = np.cumsum(in_trie) - 1
    trie = TriePart(words[met], in_words[place[in_trie]], second[in_trie], in_pairs[pair[kept]], third[kept], pair_code[in_trie], code, first_back[met], pair_back[in_trie])
    return trie, context, of_word


def _answers(id_bits: int, min_count: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked, firsts, seconds, thirds, counts, flags = [], [], [], [], [], []
        for data in pdf["data"]:
            first, n_pairs, second, n_triples, third, count, split, hot = unblob(data)
            asked.append((len(first), n_pairs, n_triples, split, hot))
            firsts.append(np.repeat(np.cumsum(first), n_pairs))
            seconds.append(second)
            thirds.append(third)
            counts.append(count)
            flag = np.zeros(len(second), bool)
            flag[split] = True
            flags.append(flag)
        mask = (1 << id_bits) - 1
        pairs, pair = np.unique((np.concatenate(firsts) << id_bits) | np.concatenate(seconds), return_inverse=True)
        n_triples = np.concatenate([n for _, _, n, _, _ in asked])
        triples, triple = np.unique((np.repeat(pair, n_triples) << id_bits) | np.concatenate(thirds), return_inverse=True)
        split = np.bincount(pair, np.concatenate(flags), len(pairs)) > 0
        first, second, of_pair, third = pairs >> id_bits, pairs & mask, triples >> id_bits, triples & mask
        trie, context, of_word = build_part(first, second, split, of_pair, third, np.bincount(triple, np.concatenate(counts), len(triples)).astype(np.int64), min_count)
        del thirds, counts, firsts, seconds
        words = first[runs(first)]
        place = np.searchsorted(words, first)
        one_b, two_q, two_b, three_q = trie.answer(words, place, second, of_pair, third)
        out, i, j = [], 0, 0
        for n_first, n_pairs, n_own, split_at, hot_at in asked:
            p, t = pair[i : i + len(n_own)], triple[j : j + int(n_own.sum())]
            f = place[p[np.cumsum(n_pairs) - n_pairs]] if n_first else p[:0]
            out.append(blob(one_b[f], two_q[p], two_b[p], three_q[t], context[p[split_at]], of_word[f[hot_at]]))
            i, j = i + len(n_own), j + len(t)
        return pd.DataFrame({"block": pdf["block"], "shard": key[0], "data": out, "trie_bytes": trie.nbytes})

    return run


def _scores(id_bits: int, hot: int, shards: int, n_tokens: int, n_words: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                block = _Block(row, id_bits, hot, shards)
                count = block.total
                p = (count + 0.5) / (n_tokens + 0.5 * (n_words + 1))
                base = np.log10(p)
                p = block.probabilities([] if row.found is None else row.found, p)
                starts = np.cumsum(block.lengths) - block.lengths
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(np.where(block.known, block.doc_ids, 0), "Int64").copy() if block.known.all() else pd.array([int(i) if k else None for i, k in zip(block.doc_ids, block.known, strict=True)], "Int64"),
                        "n_tokens": block.lengths.astype(np.int64),
                        "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
                        "train_tokens": n_tokens,
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts),
                    }
                )

    return run


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, training: Column, min_count: int = 1, block_bytes: int = 6 << 20, shard_entries: int = 1_000_000, hot: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document, learnt from those that training holds for.

    A null text is empty: one token, the end mark. Repeated rows are learnt and scored each time; with no training
    documents N is 0 and score equals base_score; an empty table gives no rows. Texts may be of any length. min_count
    above one leaves rarer pairs and triples out of the trie, words never.
    """
    blocks = cut(encode_blocks(docs, training, block_bytes))
    entries, tokens = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_shards = max(1, -(-(entries or 0) // shard_entries))
    asked = blocks.select("block", "words").mapInPandas(_word_requests(word_shards), "shard int, block long, data binary")
    answers = cut(asked.groupBy("shard").applyInPandas(_word_answers(word_shards), "block long, shard int, data binary, tokens long, words long, most long"))
    n_tokens, n_words, most = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("words"), F.max("most")).first())
    id_bits = max(1, int(most).bit_length())
    by_block = answers.groupBy("block").agg(F.collect_list("data").alias("answers"))
    filled = blocks.select("block", "n_words", "docs", "end").join(by_block, "block")
    shards = max(1, -(-(tokens or 0) // shard_entries))
    requests = filled.mapInPandas(_requests(id_bits, hot, shards), "shard int, block long, data binary")
    found = requests.groupBy("shard").applyInPandas(_answers(id_bits, min_count), "block long, shard int, data binary, trie_bytes long")
    of_block = found.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("found"))
    return filled.join(of_block, "block", "left").mapInPandas(_scores(id_bits, hot, shards, n_tokens, n_words), SCORES)
