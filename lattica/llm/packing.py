"""Best-fit packing of tokenised documents into sequences, by bin completion on the histogram of lengths.

A packing depends on lengths only, and there are no more lengths than tokens in a sequence. So the driver gets one
count for each length (2048 rows for any input), solves the packing on counts, and its plan - patterns of lengths with
the number of sequences that use each - goes back to the rows, which find their place by their rank within their length.

The solver: best-fit decreasing gives the first incumbent. If that misses the lower bound, bin completion branches on
the fillings around the largest document left, undominated ones only, least waste first, applies a filling as often as
the counts allow, and prunes by waste: a branch that has wasted more than a better packing could is left.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from lattica.llm.common import HASH_SPAN, arrow_rows, batches, cut, narrow, rank_within

DEFAULT_TOKENIZER = "word_bpe_49k.json"
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


class WordEncoder:
    """Little-endian 32-bit ids of a text, as the file's own tokenizer gives them, with a bounded cache of words.

    The vocabulary lower-cases, drops white space and never merges over it, so a text's ids are those of its words in
    turn. Words of letters go through the same merges in tiktoken (the end-of-word mark as byte 255, which no UTF-8
    text holds); anything else goes through the tokenizer itself, and so do whole texts in which lower-casing, white
    space, normal form or special tokens could reach over a word.
    """

    _ODD = re.compile("[\x1c-\x1fİΣ]|<\\|")

    def __init__(self, path: str, most_words: int = 200_000) -> None:
        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = {chr(c): b for b, c in self._byte_signs().items()}
        ranks = {}
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            if all(c in shown for c in body) and not token.startswith("<|"):
                ranks[bytes(shown[c] for c in body) + b"\xff" * (body != token)] = i
        self.word = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.most, self.cache = most_words, {}

    @staticmethod
    def _byte_signs() -> dict[int, int]:
        """The printable sign that stands for each byte in byte-level vocabularies."""
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        return {b: b for b in kept} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in kept)}

    def _pieces(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if core.isalpha():
            ids = self.word(core.encode() + b"\xff")
            if core != word:
                return np.array(ids, "<u4").tobytes() + self._of(word[len(core) :])
        else:
            ids = self.plain.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _of(self, word: str) -> bytes:
        if (got := self.cache.get(word)) is None:
            got = self.cache[word] = self._pieces(word)
        return got

    def __call__(self, text: str) -> bytes:
        if self._ODD.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
            if self._ODD.search(text):
                return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            pass
        if len(self.cache) > self.most:
            self.cache.clear()
        return b"".join(map(self._of, words))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, capacity: int, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each text's ids with end_id after them, cut every capacity tokens.

    A null or empty text is the end id alone.
    """
    path = path or tokenizer_path()
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
    tail = int(end_id).to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = _encoder(path), 4 * capacity
        for batch in batches(it, 1 << 23):
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(t or "") + tail
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    out.append((k, at // width, at // 4, len(part) // 4, zlib.crc32(part)))
            yield arrow_rows(schema, zip(*out, strict=True))

    out = narrow(docs.select(key, text)).mapInArrow(run, "key long, piece int, start long, length long, crc long")
    return out.select(F.col("key").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"))


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2 on counts: no packing has fewer sequences."""
    best = -(-sum(s * n for s, n in sizes.items()) // capacity)
    for k in sorted(s for s in sizes if 2 * s <= capacity) or [0]:
        large = sum(n for s, n in sizes.items() if s > capacity - k)
        half = {s: n for s, n in sizes.items() if 2 * s > capacity and s <= capacity - k}
        small = sum(s * n for s, n in sizes.items() if k <= s and 2 * s <= capacity)
        n_half = sum(half.values())
        room = n_half * capacity - sum(s * n for s, n in half.items())
        best = max(best, large + n_half + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(sizes: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: bins of one filling are moved together."""
    open_: dict[int, list[list]] = {}  # room left -> [bins, filling]
    rooms: list[int] = []

    def put(room: int, bins: int, filling: tuple) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([bins, filling])

    for s in sorted(sizes, reverse=True):
        left = sizes[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                fit = capacity // s
                if left >= fit:
                    put(capacity - fit * s, left // fit, ((s, fit),))
                if left % fit:
                    put(capacity - left % fit * s, 1, ((s, left % fit),))
                break
            room = rooms[at]
            bins, filling = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fit = room // s
            full = min(bins, left // fit)
            if full:
                put(room - fit * s, full, (*filling, (s, fit)))
                left -= full * fit
            if full < bins and 0 < left < fit:
                put(room - left * s, 1, (*filling, (s, left)))
                left, full = 0, full + 1
            if full < bins:
                put(room, bins - full, filling)
    return [(bins, filling) for group in open_.values() for bins, filling in group]


def fillings(counts: dict[int, int], room: int, most: int, tries: int = 300) -> list[tuple[tuple[int, int], ...]]:
    """Undominated fillings of room by the documents in counts, least waste first, most of them at most.

    A filling is dominated if some of its documents (or none) could be changed for one larger document, left out so
    far, within room. Sums that can be made are known beforehand, so the fillings of the least waste are met first,
    whatever their documents. tries bounds the fillings looked at.
    """
    order = sorted((s for s in counts if s <= room), reverse=True)
    # reach[i]: the sums that documents from order[i] on can make, as bits
    reach = [1] * (len(order) + 1)
    for i in reversed(range(len(order))):
        sums, left, step = reach[i + 1], min(counts[order[i]], room // order[i]), 1
        while left:
            step = min(step, left)
            sums |= sums << step * order[i]
            left, step = left - step, 2 * step
        reach[i] = sums & ((1 << room + 1) - 1)

    def undominated(chosen: tuple, slack: int) -> bool:
        sums = 1
        for s, n in chosen:
            for _ in range(n):
                sums |= sums << s
        held, window = dict(chosen), (1 << slack) - 1
        for x in order:
            if counts[x] == held.get(x, 0):
                continue
            # some documents of the filling sum to less than x, by slack at most
            below = sums >> (x - slack) if x >= slack else sums << (slack - x)
            if below & window:
                return False
        return True

    def fill(i: int, left: int, chosen: tuple) -> Iterator[tuple]:
        """Fillings of left by documents from order[i] on, larger ones first; no way leads nowhere."""
        if not left:
            yield chosen
            return
        for j in range(i, len(order)):
            if not reach[j] >> left & 1:
                return
            s = order[j]
            for n in range(min(counts[s], left // s), 0, -1):
                if reach[j + 1] >> left - n * s & 1:
                    yield from fill(j + 1, left - n * s, (*chosen, (s, n)))

    out: list[tuple] = []
    looked, total = 0, reach[0].bit_length() - 1
    least = total
    while looked < tries and len(out) < most:
        for chosen in fill(0, total, ()):
            looked += 1
            if undominated(chosen, room - total):
                out.append(chosen)
            if looked == tries or len(out) == most:
                break
        smaller = reach[0] & ((1 << total) - 1)
        if not smaller:
            break
        total = smaller.bit_length() - 1
    return out or [next(fill(0, least, ()))]


def pack_counts(sizes: dict[int, int], capacity: int, nodes: int = 2500, width: int = 4) -> list[Pattern]:
    """(sequences, ((length, documents), ...)) patterns that hold all documents in as few sequences as the search finds.

    nodes bounds the fillings tried (a limit of search time, not of documents); the best packing so far is returned.
    """
    sizes = {s: n for s, n in sizes.items() if n}
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("a length is outside 1 to capacity")
    incumbent = best_fit_decreasing(sizes, capacity)
    least, total = lower_bound(sizes, capacity), sum(s * n for s, n in sizes.items())
    best = [sum(b for b, _ in incumbent), incumbent]
    budget = [nodes]

    def pruned(used: int, waste: int) -> bool:
        return used >= best[0] or waste > (best[0] - 1) * capacity - total

    # depth first, by hand: counts change in place and are restored on the way back
    counts = dict(sizes)

    def options() -> list:
        s = max(counts)
        rest = {**counts, s: counts[s] - 1} if counts[s] > 1 else {x: n for x, n in counts.items() if x != s}
        return [Counter(dict(f)) + Counter({s: 1}) for f in fillings(rest, capacity - s, width)]

    def change(filling: Counter, times: int) -> None:
        for s, n in filling.items():
            counts[s] = counts.get(s, 0) - n * times
            if not counts[s]:
                del counts[s]

    path: list[tuple[Counter, int]] = []
    stack = [iter(options())] if counts and best[0] > least else []
    used = waste = 0
    while stack and budget[0] > 0 and best[0] > least:
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            if path:
                f, times = path.pop()
                change(f, -times)
                used, waste = used - times, waste - times * (capacity - sum(s * n for s, n in f.items()))
            continue
        budget[0] -= 1
        times = min(counts[s] // n for s, n in filling.items())
        spill = times * (capacity - sum(s * n for s, n in filling.items()))
        change(filling, times)
        used, waste = used + times, waste + spill
        path.append((filling, times))
        if not counts and used < best[0]:
            best[:] = [used, [(t, tuple(f.items())) for f, t in path]]
        stack.append(iter([] if not counts or pruned(used, waste) else options()))
    return best[1]


def pack_pieces(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """pieces with sequence_id and offset; length must lie in 1 to capacity and pieces must be a written copy."""
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan, base = [], 0
    taken: Counter = Counter()
    for bins, filling in pack_counts(hist, capacity):
        merged, offset = Counter(), 0
        for s, n in filling:
            merged[s] += n
        for s, n in merged.items():
            plan.append((s, taken[s], n, base, offset))
            taken[s] += n * bins
            offset += n * s
        base += bins
    plan.sort()
    size, first, each, base_, offset_ = (np.array(x, np.int64) for x in (zip(*plan, strict=True) if plan else [[]] * 5))
    shift = 1 << 42
    at = size * shift + first
    columns = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            i = np.searchsorted(at, length * shift + rank, side="right") - 1
            nth = rank - first[i]
            pdf["sequence_id"] = base_[i] + nth // each[i]
            pdf["offset"] = offset_[i] + nth % each[i] * length
            yield pdf[columns]

    total = sum(hist.values())
    keyed = pieces.withColumn("_hash", F.xxhash64(*keys).bitwiseAND(HASH_SPAN - 1))
    return rank_within(keyed, "length", keys, total).mapInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places.

    Places are gapless from 0 in each sequence. A repeated doc_id is packed once for each of its rows; an empty table
    gives no rows.
    """
    return pack_pieces(cut(token_pieces(docs, capacity, path)), capacity, ["doc_id", "piece"])
