"""Benchmark decontamination by SimHash of item-sized windows.

Benchmark items of similar length form a class; a window of a text with a class's length gets
a 64-bit SimHash of its five-word shingles (kept as running bit counts, so a window costs one
subtraction for each bit).  A multi-index over the items' fingerprints has four blocks of 16
bits, each a table from a block's value to the items listed there: fingerprints within radius
4 q + 3 agree on some block up to q bits, so the q bits are shared out between the lists (an
item is listed under all values within i bits of its own) and the probes (a window looks up all
values within q - i bits); i falls as the items grow in number.  The pairs so retrieved take the
full Hamming test, and survivors are verified on the exact windows of the item's own length
around them: weighted Jaccard of shingle multisets, a shingle's weight being one over the number
of different item texts of the whole benchmark that hold it.

A window with too few shingles of any item cannot reach the similarity: foreign shingles weigh 1
each and known ones at most 1, so of a window's shingles a share of ``SIMILARITY`` must be known.
Such windows are passed over, which loses nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, blocks, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: bits by which one block may differ; fingerprints within 4 * BLOCK_RADIUS + 3 are found
BLOCK_RADIUS = 3
RADIUS = 4 * BLOCK_RADIUS + 3
#: lengths within this ratio share a class of windows
CLASS_RATIO = 1.12
#: items, and characters of their texts, that one pass over the documents compares; more take more passes
ITEMS_PER_PASS, CHARS_PER_PASS = 1 << 17, 1 << 26
#: places in the lists of one block; an item is listed under so many values as fit
LIST_PLACES = 1 << 21
#: pairs that are looked at together
PAIRS = 1 << 20
CHUNK = 1024


def _shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and the index of each text's first (length texts + 1)."""
    count = w.counts()
    n = np.where(count == 0, 0, np.maximum(1, count - k + 1))
    first = np.concatenate(([0], np.cumsum(n)))
    whole = shingle_hashes(w.hash, k) if len(w.hash) >= k else np.zeros(0, np.uint64)
    out = np.zeros(first[-1], np.uint64)
    long = np.flatnonzero(count >= k)
    if len(long):
        at = np.repeat(w.first[long] - first[long], n[long]) + np.concatenate([np.arange(first[i], first[i + 1]) for i in long])
        out[np.concatenate([np.arange(first[i], first[i + 1]) for i in long])] = whole[at]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[first[i]] = shingle_hashes(w.hash[w.first[i] : w.first[i + 1]], k)[0]
    return out, first


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def _pack(more: np.ndarray) -> np.ndarray:
    return np.packbits(more, axis=1).view(np.uint64).ravel()


def simhash(h: np.ndarray) -> int:
    """Majority of each bit over the shingles; an even split is 0."""
    return int(_pack((2 * _bits(h).sum(0, dtype=np.int64) > len(h))[None])[0])


def _masks(radius: int) -> np.ndarray:
    """All 16-bit words of at most so many ones."""
    x = np.arange(1 << 16, dtype=np.uint64)
    return x[np.bitwise_count(x) <= radius]


class BlockLists:
    """For each of four 16-bit blocks, the items listed under each of its values."""

    def __init__(self, prints: np.ndarray, numbers: np.ndarray):
        listed = max(i for i in range(BLOCK_RADIUS + 1) if i == 0 or len(prints) * len(_masks(i)) <= LIST_PLACES)
        self.prints, self.numbers, self.probes = prints, numbers, _masks(BLOCK_RADIUS - listed)
        around, self.lists = _masks(listed), []
        for b in range(4):
            value = (self._value(prints, b)[:, None] ^ around).ravel()
            item = np.repeat(np.arange(len(prints), dtype=np.int32), len(around))
            order = np.argsort(value, kind="stable")
            start = np.concatenate(([0], np.cumsum(np.bincount(value.astype(np.int64), minlength=1 << 16)))).astype(np.int32)
            self.lists.append((start, item[order]))

    @staticmethod
    def _value(prints, b):
        return (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)

    def retrieve(self, prints: np.ndarray):
        """(window, item number) pairs within the radius, each once."""
        out = []
        for lo in range(0, len(prints), max(1, PAIRS // len(self.probes))):
            some = prints[lo : lo + max(1, PAIRS // len(self.probes))]
            pairs = [np.zeros(0, np.int64)]
            for b, (start, item) in enumerate(self.lists):
                value = (self._value(some, b)[:, None] ^ self.probes).astype(np.int64)
                size = start[value + 1] - start[value]
                row, col = np.nonzero(size)
                first, size = start[value[row, col]], size[row, col]
                for at in range(0, len(row), PAIRS):
                    f, n, r = first[at : at + PAIRS], size[at : at + PAIRS], row[at : at + PAIRS]
                    place = np.repeat(f - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    x, y = np.repeat(r, n), item[place].astype(np.int64)
                    near = np.bitwise_count(some[x] ^ self.prints[y]) <= RADIUS
                    pairs.append(np.unique(x[near] * len(self.prints) + y[near]))
            found = np.unique(np.concatenate(pairs))
            out.append((found // len(self.prints) + lo, self.numbers[found % len(self.prints)]))
        x, y = zip(*out, strict=True) if out else ((np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
        return np.concatenate(x), np.concatenate(y)


class WindowIndex:
    """The different texts of one pass's items, their fingerprints and block lists by length class.

    ``shared`` has the shingles of more than one text of the benchmark, sorted, and their numbers of
    texts; without it the items are the whole benchmark.  ``ids`` has the item ids of each text.
    """

    def __init__(self, items: list[tuple[int, str]], shared: tuple[np.ndarray, np.ndarray] | None = None):
        texts: dict[bytes, list[int]] = {}
        self.sets: list[np.ndarray] = []
        self.ids: list[list[int]] = []
        ids = [i for i, _ in items]
        for at, group in blocks([t for _, t in items]):
            h, first = _shingles(Words(group))
            for k, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
                key = h[lo:hi].tobytes()
                if key not in texts:
                    texts[key] = []
                    self.sets.append(h[lo:hi].copy())
                    self.ids.append(texts[key])
                texts[key].append(ids[at + k])
        whole = np.concatenate([np.unique(s) for s in self.sets]) if self.sets else np.zeros(0, np.uint64)
        known, count = np.unique(whole, return_counts=True)
        self.shared, self.texts = (known[count > 1], count[count > 1]) if shared is None else shared
        prints = np.array([simhash(s) if len(s) else 0 for s in self.sets], np.uint64)
        size = np.array([len(s) for s in self.sets], np.int64)
        bits = min(1 << 27, max(1 << 20, 1 << (64 * len(known)).bit_length()))
        self.screen = np.zeros(bits, bool)
        self.screen[known & np.uint64(bits - 1)] = True
        self.classes = []
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        while len(order):
            low = int(size[order[0]])
            some, order = np.split(order, [np.searchsorted(size[order], low * CLASS_RATIO, "right")])
            high = int(size[some[-1]])
            length = (low + high + 1) // 2
            # a window of the class holds the item's, or lacks less of it than the lengths differ
            known_least = math.ceil(min(SIMILARITY * low, length - (1 - SIMILARITY) * high) - 1e-9)
            self.classes.append((length, low, max(1, known_least), BlockLists(prints[some], some)))

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """Arrays (first shingle, last + 1, item) of windows whose fingerprints are in the radius."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        known = np.concatenate(([0], np.cumsum(self.screen[h & np.uint64(len(self.screen) - 1)])))
        out = []
        windows = []
        for s, _, least, _ in self.classes:
            n = max(0, len(h) - s + 1)
            a = np.flatnonzero(known[s : s + n] - known[:n] >= least)
            windows.append(a[text[a] == text[a + s - 1]])
        most = max(c[0] for c in self.classes)
        kind = np.uint8 if most < 256 else np.int64
        for lo in sorted({x for a in windows for x in np.unique(a // CHUNK).tolist()}):
            lo *= CHUNK
            hi = min(len(h), lo + CHUNK + most - 1)
            c = np.zeros((hi - lo + 1, 64), kind)
            np.cumsum(_bits(h[lo:hi]), axis=0, dtype=kind, out=c[1:])
            for (s, _, _, lists), a in zip(self.classes, windows, strict=True):
                a = a[np.searchsorted(a, lo) : np.searchsorted(a, lo + CHUNK)]
                if len(a):
                    at, item = lists.retrieve(_pack((c[a - lo + s] - c[a - lo]) > s // 2))
                    out.append((a[at], a[at] + s, item))
        # texts shorter than a class's window are windows themselves
        size = np.diff(first)
        for s, low, _, lists in self.classes:
            short = np.flatnonzero((size < s) & (size >= SIMILARITY * low))
            short = short[known[first[short + 1]] - known[first[short]] >= SIMILARITY * size[short]]
            if len(short):
                prints = np.array([simhash(h[first[i] : first[i + 1]]) for i in short], np.uint64)
                at, item = lists.retrieve(prints)
                out.append((first[short[at]], first[short[at] + 1], item))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _weights(self, shingles) -> dict[int, float]:
        """Weight of each shingle: one over its number of texts, 1 for one text or none."""
        x = np.fromiter(shingles, np.uint64)
        if not len(self.shared):
            return dict.fromkeys(x.tolist(), 1.0)
        at = np.minimum(np.searchsorted(self.shared, x), len(self.shared) - 1)
        return dict(zip(x.tolist(), np.where(self.shared[at] == x, 1.0 / self.texts[at], 1.0).tolist(), strict=True))

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of two shingle multisets."""
        a, b = Counter(window.tolist()), Counter(self.sets[item].tolist())
        weight = self._weights(a.keys() | b.keys())
        both = sum(min(n, b[x]) * weight[x] for x, n in a.items() if x in b)
        either = sum(n * weight[x] for x, n in a.items()) + sum(n * weight[x] for x, n in b.items()) - both
        return both / either

    def matches(self, group: list[bytes]) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item) -> (best similarity, first word) of the pairs that reach ``SIMILARITY``."""
        h, first = _shingles(Words(group))
        if not len(h) or not self.classes:
            return {}
        a, b, item = self.candidates(h, first)
        text = np.searchsorted(first, a, "right") - 1
        best: dict[tuple[int, int], tuple[float, int]] = {}
        done = set()
        for s, e, t, i in sorted(zip(a.tolist(), b.tolist(), text.tolist(), item.tolist(), strict=True)):
            size, lo, hi = len(self.sets[i]), int(first[t]), int(first[t + 1])
            slack = abs(e - s - size) + 2
            for at in range(max(lo, s - slack), max(lo, min(s + slack, hi - size)) + 1):
                if (t, i, at) in done:
                    continue
                done.add((t, i, at))
                sim = self.similarity(h[at : min(hi, at + size)], i)
                if sim >= SIMILARITY and sim > best.get((t, i), (0.0, 0))[0]:
                    best[t, i] = (sim, at - lo)
        return best


def _shingle_rows(batches):
    """Item texts -> (shingle, text): the different shingles of each text, and a digest of all of them in order."""
    for batch in batches:
        for _, group in blocks(batch.column(0).to_pylist()):
            h, first = _shingles(Words(group))
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                if hi > lo:
                    u = np.unique(h[lo:hi])
                    digest = int.from_bytes(hashlib.blake2b(h[lo:hi].tobytes(), digest_size=8).digest(), "little", signed=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), digest, np.int64))], ["shingle", "text"])


def _shared(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of more than one text of the whole benchmark, sorted, and their numbers of texts; equal texts count once."""
    rows = texts.mapInArrow(_shingle_rows, "shingle long, text long").distinct().groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    shingle, n = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _passes(benchmark: DataFrame, id_col: str, text_col: str):
    """The items by hash of their id, one pass's at a time; the driver holds these and the shingles that texts share."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars")).first()
    n = max(-(-size.n // ITEMS_PER_PASS), -(-(size.chars or 0) // CHARS_PER_PASS))
    shared = _shared(items.select("t")) if n else None
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).distinct().orderBy("i", "t").collect()
        if got:
            yield benchmark.sparkSession.sparkContext.broadcast(WindowIndex([(r.i, r.t) for r in got], shared))


def _finder(index):
    def find(batches):
        known = index.value
        for batch in batches:
            ids, rows = batch.column(0), []
            for at, group in blocks(batch.column(1).to_pylist()):
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for (t, i), (s, p) in known.matches(group).items():
                    for item in known.ids[i]:
                        best[t, item] = max(best.get((t, item), (0.0, 0)), (s, -p))
                rows += [(at + t, item, s, -p) for (t, item), (s, p) in sorted(best.items())]
            at, item, sim, pos = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(pos, pa.int64())],
                ["id", "item_id", "similarity", "first_word"],
            )

    return find


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, similarity, first_word): each text and item with a window of similarity 0.8 or more.

    One row for each row of ``docs`` and item that match, with the best window.  Null and
    empty texts and items match nothing; an item of fewer than five words is one shingle,
    which only a text of just these words holds; repeated rows match alike; other columns
    are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item_id long, similarity double, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _passes(benchmark, item_col, item_text):
        out = out.union(texts.mapInArrow(_finder(index), schema))
    return out


def _cleaner(index, column: int):
    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, group in blocks(batch.column(column).to_pylist()):
                keep[[at + t for t, _ in index.value.matches(group)]] = False
            yield batch.filter(pa.array(keep))

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts match no benchmark item."""
    for index in _passes(benchmark, item_col, item_text):
        docs = docs.mapInArrow(_cleaner(index, docs.columns.index(text_col)), docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark``, with the item and the similarity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, benchmark).withColumnRenamed("id", "doc_id")
