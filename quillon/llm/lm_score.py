"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised (exact up to
``EXACT``, then in steps of ``RATIO``) and held in a Bloom filter: an n-gram of level q is
inserted with each of 1..q, so its level is found by probing 1, 2, ... until a probe fails.
The filter is built in segments, each sized for its own insertions by the task that holds
its n-grams, and broadcast to the workers.  A segment is made of cache lines, eight levels of
an n-gram lie in one, and lines follow the order of the keys, so sorted keys are probed in
the order of memory.  Probabilities interpolate pairs with words,

    P(w|h) = (1 - l) c(hw) / c(h) + l (c(w) + 1) / (N' + V + 1),

where the weight l depends on the level of c(h) and is fitted by EM on leave-one-out
likelihoods of all training tokens, gathered as a histogram of fixed size.  Where the
filter would exceed ``max_filter_bytes`` it is not broadcast: the distinct n-grams of each
block of text go to the tasks that hold their segments, are probed there in the same way,
and their levels come back to the block.  Both ways give the same levels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .textkit import Words, blocks, mix

EXACT, RATIO = 6, 1.5
SEGMENTS, HASHES, BITS = 4096, 4, 10
LINE, TOGETHER, MOST_LEVELS = 512, 8, 96
MAX_FILTER_BYTES = 256 << 20
#: words with at least a 2^-20 share of the training tokens: at most 2^20 of them, broadcast exactly
HEAVY = 1 << 20
RATIO_BINS, BIN_STEP = 40, 0.25
_TOP = np.uint64(1)
#: hashes of words, of the end and of the beginning are even, those of pairs odd
END, BEGIN = (int(x) for x in mix(np.array([1, 2], np.uint64), 991) & ~_TOP)
#: blocks of text whose counts a task adds up before it sends them
BLOCKS_TOGETHER = 12
#: texts whose levels are opened together
ROWS_TOGETHER = 256


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised level of a count; 0 only for 0."""
    c = np.asarray(count, float)
    over = EXACT + np.floor(np.log(np.maximum(c, EXACT) / EXACT) / math.log(RATIO) + 1e-9)
    return np.where(c <= EXACT, c, over).astype(np.int64)


def level_floor(level: np.ndarray) -> np.ndarray:
    """Smallest count of a level."""
    q = np.asarray(level, float)
    return np.where(q <= EXACT, q, EXACT * RATIO ** np.maximum(0, q - EXACT))


def level_ceiling(level: np.ndarray) -> np.ndarray:
    """Largest count of a level, nearly."""
    q = np.asarray(level, float)
    return np.where(q < EXACT, q, np.maximum(q, EXACT * RATIO ** np.maximum(0, q - EXACT + 1) - 1))


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h, 5) ^ w, 22) | _TOP


def sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with one end after each, their contexts, and first indices (texts + 1)."""
    n = w.counts()
    first = np.concatenate(([0], np.cumsum(n + 1)))
    tokens = np.full(first[-1], END, np.uint64)
    words = np.ones(len(tokens), bool)
    words[first[1:] - 1] = False
    tokens[words] = w.hash & ~_TOP
    context = np.concatenate(([BEGIN], tokens[:-1])).astype(np.uint64)
    context[first[:-1]] = BEGIN
    return tokens, context, first


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(52)).astype(np.int64)


def _lines(keys: np.ndarray, group: int, count: np.ndarray):
    """The cache line of a key for a group of levels, and the two numbers that place its bits."""
    h = mix(keys, 31 + group)
    place = (keys >> np.uint64(20)) if group == 0 else (h >> np.uint64(7))
    line = ((place & np.uint64(0xFFFFFFFF)) * count) >> np.uint64(32)
    return line, h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | _TOP


def _bit(a: np.ndarray, b: np.ndarray, level: int, j: int) -> np.ndarray:
    return ((a + np.uint64(level * HASHES + j) * b) & np.uint64(0xFFFFFFFF)) >> np.uint64(23)


def build_segment(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The words of one segment's bits; every key is inserted with 1..level."""
    count = max(1, -(-int(levels.sum()) * BITS // LINE))
    out = np.zeros(count * (LINE // 64), np.uint64)
    for group in range(-(-int(levels.max(initial=0)) // TOGETHER)):
        some = levels > group * TOGETHER
        line, a, b = _lines(keys[some], group, np.uint64(count))
        for level in range(group * TOGETHER + 1, (group + 1) * TOGETHER + 1):
            ok = levels[some] >= level
            for j in range(HASHES):
                pos = _bit(a[ok], b[ok], level, j)
                np.bitwise_or.at(out, (line[ok] * np.uint64(8) + (pos >> np.uint64(6))).astype(np.int64), _TOP << (pos & np.uint64(63)))
    return out


class LogFrequencyFilter:
    def __init__(self, offsets: np.ndarray, words: np.ndarray):
        self.offsets, self.words = offsets, words

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, by probing 1, 2, ... until one fails; never too low.  Sorted keys are fastest."""
        out = np.zeros(len(keys), np.int64)
        for lo in range(0, len(keys), 1 << 14):
            out[lo : lo + (1 << 14)] = self._levels(keys[lo : lo + (1 << 14)])
        return out

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        seg = segment_of(keys)
        start = self.offsets[seg]
        count = (self.offsets[seg + 1] - start) // (LINE // 64)
        alive = np.flatnonzero(count > 0)
        start, count = start[alive], count[alive].astype(np.uint64)
        level = 0
        while len(alive):
            if level % TOGETHER == 0:
                line, a, b = _lines(keys[alive], level // TOGETHER, count)
                base = start + line.astype(np.int64) * (LINE // 64)
            level += 1
            keep = None
            for j in range(HASHES):
                x, y, z = (a, b, base) if keep is None else (a[keep], b[keep], base[keep])
                pos = _bit(x, y, level, j)
                hit = ((self.words[z + (pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & _TOP).astype(bool)
                keep = np.flatnonzero(hit) if keep is None else keep[hit]
            alive, a, b, base, start, count = alive[keep], a[keep], b[keep], base[keep], start[keep], count[keep]
            out[alive] = level
        return out


def _counter(batches):
    """Counts of the words and pairs of training texts: (key, n), added up over a few blocks of text."""

    def send(held):
        u, n = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(u), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + (1 << 18)].view(np.int64)), pa.array(n[lo : lo + (1 << 18)])], ["key", "n"])

    held = []
    for batch in batches:
        for _, group in blocks(batch.column(0).to_pylist()):
            tokens, context, _ = sequence(Words(group))
            held += [tokens, pair_keys(context, tokens)]
            if len(held) >= 2 * BLOCKS_TOGETHER:
                yield from send(held)
                held = []
    if held:
        yield from send(held)


def _builder(batches):
    """Rows by segment -> one row for each: its bits, its words and their exact counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        is_word = (key & _TOP) == 0
        bits = build_segment(key, level_of(n))
        q = level_floor(level_of(n[is_word]))
        return pa.RecordBatch.from_arrays(
            [pa.array(segment_of(key[:1]).astype(np.int32)), pa.array([bits.tobytes()], pa.binary()), pa.array([bits.nbytes]),
             pa.array([key[is_word].view(np.int64)], pa.list_(pa.int64())), pa.array([n[is_word]], pa.list_(pa.int64())), pa.array([float(q.sum())])],
            ["seg", "bits", "size", "words", "counts", "mass"],
        )

    for batch in batches:
        key, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        seg = segment_of(key)
        cut = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1), len(seg)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi == lo:
                continue
            if held and segment_of(held[0][0][:1])[0] != seg[lo]:
                yield flush()
                held = []
            held.append((key[lo:hi].copy(), n[lo:hi].copy()))
    if held:
        yield flush()


class Interpolated:
    """The model's numbers: N', V and the weight of the word model for each level of the context, as tables by level."""

    def __init__(self, mass: float, types: int, weights: np.ndarray):
        q = np.arange(MOST_LEVELS)
        self.mass, self.types, self.weights = mass, types, weights
        self.low, self.high = level_floor(q), np.maximum(1, level_ceiling(q))
        self.word = (self.low + 1) / (mass + types + 1)
        with np.errstate(divide="ignore"):
            # leave-one-out: a token's own occurrence is taken from its pair and its context
            self.log_pair = np.log10(np.maximum(0, self.low - 1))
            self.log_context = np.log10(np.maximum(0, level_ceiling(q) - 1))
        self.left_level = level_of(np.maximum(0, self.low - 1))
        self.log_word = np.log10(np.maximum(self.low, 1) / (mass + types + 1))

    def log10(self, q_pair, q_context, q_word):
        weight = self.weights[q_context]
        pair = np.where(q_context > 0, np.minimum(1.0, self.low[q_pair] / self.high[q_context]), 0.0)
        return np.log10((1 - weight) * pair + weight * self.word[q_word])

    def ratio_bins(self, q_pair, q_context, q_word) -> np.ndarray:
        """Leave-one-out: bin of log10 of the pair's probability over the word's; bin 0 is a pair not seen elsewhere."""
        with np.errstate(invalid="ignore"):
            r = np.minimum(0, self.log_pair[q_pair] - self.log_context[q_context]) - self.log_word[q_word]
            bins = np.clip(np.round(r / BIN_STEP) + RATIO_BINS // 4, 1, RATIO_BINS - 1)
        return np.where(np.isfinite(r), bins, 0).astype(np.int64)


def _levels(filt: LogFrequencyFilter, tokens: np.ndarray, context: np.ndarray):
    """Levels of pairs and words; each distinct one is probed once."""
    u, back = np.unique(tokens, return_inverse=True)
    q_word = filt.levels(u)[back]
    u, back = np.unique(pair_keys(context, tokens), return_inverse=True)
    return filt.levels(u)[back], q_word


def fit_weights(rows: list, levels: int = MOST_LEVELS, rounds: int = 60) -> np.ndarray:
    """EM on rows (level, bin, n), each level for itself, drawn to the weight of all."""
    n = np.zeros((levels, RATIO_BINS))
    for r in rows:
        n[min(r.level, levels - 1), r.bin] += r.n
    ratio = np.concatenate(([0], 10 ** ((np.arange(1, RATIO_BINS) - RATIO_BINS // 4) * BIN_STEP)))

    def em(m, prior):
        w = 0.5
        for _ in range(rounds):
            w = (prior * 20 + (m * (w / (w + (1 - w) * ratio))).sum()) / (20 + m.sum())
        return w

    whole = em(n.sum(0), 0.5)
    out = np.array([em(x, whole) for x in n])
    out[0] = 1.0  # an unknown context says nothing
    return np.clip(out, 1e-4, 1.0)


def _open(parts) -> LogFrequencyFilter:
    offsets, raw = parts.value
    return LogFrequencyFilter(offsets, np.frombuffer(raw, np.uint64))


class KnownLevels:
    """Levels that were probed elsewhere, of sorted keys."""

    def __init__(self, keys: np.ndarray, found: np.ndarray):
        self.keys, self.found = keys, found

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]


def _probed(parts):
    """Rows (id, flags, text) -> (ids, flags, encoded texts, filter) of each block of text."""

    def source(batches):
        filt = _open(parts)
        for batch in batches:
            for at, group in blocks(batch.column(2).to_pylist()):
                yield batch.column(0).slice(at, len(group)), batch.column(1).slice(at, len(group)), group, filt

    return source


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]


def _distinct(group: list[bytes]) -> np.ndarray:
    """Sorted keys of all words and pairs of some texts."""
    tokens, context, _ = sequence(Words(group))
    return np.unique(np.concatenate((tokens, pair_keys(context, tokens))))


def _runs(batches):
    """Tables of consecutive rows that agree in the first column, also across batches."""
    held = []
    for batch in batches:
        value = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1), len(value)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi == lo:
                continue
            if held and held[0].column(0)[0].as_py() != value[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _numberer(batches):
    """Texts with the number of their block and their place in it."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at, group in blocks(batch.column(2).to_pylist()):
            block = np.full(len(group), (part << 40) + n, np.int64)
            n += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(np.arange(len(group), dtype=np.int32)), *(c.slice(at, len(group)) for c in batch.columns)], ["block", "at", "id", "flags", "text"]
            )


def _lister(batches):
    """Distinct keys of each block, a row for each segment.  A block that two tasks share is listed
    in parts, each under the place of its first text."""
    for run in _runs(batches):
        keys = _distinct(_encoded(run["text"]))
        seg = segment_of(keys)
        cut = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(seg)]))
        n = len(cut) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(seg[cut[:-1]].astype(np.int32)), pa.array(np.full(n, run["block"][0].as_py(), np.int64)), pa.array(np.full(n, run["at"][0].as_py(), np.int32)),
             pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(keys.view(np.int64)))],
            ["seg", "block", "at", "keys"],
        )


def _prober(batches):
    """Rows by segment, its bits before the keys -> the levels of each row's keys, a byte for each."""
    held, words = -1, np.zeros(0, np.uint64)
    for batch in batches:
        seg = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1), len(seg)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi == lo:
                continue
            if seg[lo] != held:
                held, words = int(seg[lo]), np.zeros(0, np.uint64)
            bits = batch.column(4)[lo].as_py()
            if bits is not None:
                words, lo = np.frombuffer(bits, np.uint64), lo + 1
            rows = batch.slice(lo, hi - lo)
            keys = rows.column(3).flatten().to_numpy().view(np.uint64)
            offsets = np.zeros(SEGMENTS + 1, np.int64)
            offsets[held + 1 :] = len(words)
            found = np.minimum(LogFrequencyFilter(offsets, words).levels(keys), 255).astype(np.uint8)
            ends = np.concatenate(([0], np.cumsum(rows.column(3).value_lengths().to_numpy()))).astype(np.int32)
            levels = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(0), levels], ["block", "at", "seg", "levels"])


def _routed(batches):
    """Rows by block, texts before levels -> (ids, flags, encoded texts, levels) of each block or part of one."""
    for run in _runs(batches):
        n = int((run["kind"].to_numpy() == 0).sum())
        texts, rest = run.slice(0, n), run.slice(n)
        at, part = texts["at"].to_numpy(), rest["at"].to_numpy()
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            first = np.searchsorted(at, part[lo])
            some = texts.slice(first, (np.searchsorted(at, part[hi]) if hi < len(part) else n) - first)
            group = _encoded(some["text"])
            found = np.frombuffer(b"".join(rest["levels"].slice(lo, hi - lo).to_pylist()), np.uint8).astype(np.int64)
            yield some["id"].combine_chunks(), some["flags"].combine_chunks(), group, KnownLevels(_distinct(group), found)


def _with_levels(sc: Scratch, texts: DataFrame, built: DataFrame) -> DataFrame:
    """Texts (id, flags, text) by block, and after each block's the levels of its keys."""
    rows = sc.keep(texts.mapInArrow(_numberer, "block long, at int, id long, flags int, text string"))
    keys = rows.select("block", "at", "text").mapInArrow(_lister, "seg int, block long, at int, keys array<long>").withColumn("bits", F.lit(None).cast("binary"))
    bits = built.select("seg", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("at"), F.lit(None).cast("array<long>").alias("keys"), "bits")
    levels = keys.union(bits).repartition("seg").sortWithinPartitions("seg", "block").mapInArrow(_prober, "block long, at int, seg int, levels binary")
    none = F.lit(None)
    rows = rows.select("block", F.lit(0).alias("kind"), "at", F.lit(0).alias("seg"), "id", "flags", "text", none.cast("binary").alias("levels"))
    levels = levels.select("block", F.lit(1).alias("kind"), "at", "seg", none.cast("long").alias("id"), none.cast("int").alias("flags"), none.cast("string").alias("text"), "levels")
    return rows.union(levels).repartition("block").sortWithinPartitions("block", "kind", "at", "seg")


#: flags of a text: the model learns from it, its score is asked for
LEARN, TELL = 1, 2


def _reader(source, heavy):
    """One row for each text: the levels of its tokens' pairs and words, two bytes for each token; the sums over
    heavy words; and the other words with their numbers in the text."""

    def read(batches):
        words, logs = heavy.value
        if not len(words):
            words, logs = np.zeros(1, np.uint64), np.zeros(1)
        part, row = TaskContext.get().partitionId(), 0
        for ids, flags, group, filt in source(batches):
            tokens, context, first = sequence(Words(group))
            q_pair, q_word = (np.minimum(q, MOST_LEVELS - 1).astype(np.uint8) for q in _levels(filt, tokens, context))
            levels = np.stack((q_pair, q_word), axis=1).tobytes()
            u, back = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(words, u), len(words) - 1)
            known = words[at] == u
            value, known = np.where(known, logs[at], 0.0)[back], known[back]
            base, heavy_tokens = np.add.reduceat(value, first[:-1]), np.add.reduceat(known.astype(np.int64), first[:-1])
            # the other words, by text and word
            text = np.repeat(np.arange(len(group)), np.diff(first))[~known]
            rare = tokens[~known]
            order = np.lexsort((rare, text))
            text, rare = text[order], rare[order]
            cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (rare[1:] != rare[:-1]))[: len(rare)])
            times = np.diff(np.append(cut, len(rare)))
            ends = pa.array(np.searchsorted(text[cut], np.arange(len(group) + 1)).astype(np.int32))
            told = np.array(flags.to_pylist()) & TELL > 0
            uid = (part << 40) + row + np.arange(len(group))
            row += len(group)
            if not told.all():  # words are asked for only where the score is
                keep = told[text[cut]]
                ends = pa.array(np.searchsorted(text[cut][keep], np.arange(len(group) + 1)).astype(np.int32))
                cut, times = cut[keep], times[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), ids, flags, pa.array(np.diff(first)), pa.array(heavy_tokens), pa.array(base),
                 pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer((2 * first).astype(np.int32).tobytes()), pa.py_buffer(levels)]),
                 pa.ListArray.from_arrays(ends, pa.array(rare[cut].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))],
                ["uid", "id", "flags", "n_tokens", "heavy_tokens", "heavy_base", "levels", "rare", "times"],
            )

    return read


_READ = "uid long, id long, flags int, n_tokens long, heavy_tokens long, heavy_base double, levels binary, rare array<long>, times array<long>"


def _opened(column):
    """Levels of pairs, contexts and words of the texts of a column, and first indices (texts + 1); the texts have their end each."""
    first = np.concatenate(([0], np.cumsum([len(x) // 2 for x in column.to_pylist()])))
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
    q_word = both[:, 1]
    # a token's context is the word before it, a first one's counts as the end
    q_context = np.concatenate((q_word[:1], q_word[:-1]))
    q_context[first[:-1]] = q_word[first[1:] - 1]
    return (both[:, 0], q_context, q_word), first


def _gatherer(model: Interpolated):
    def gather(batches):
        total = np.zeros(MOST_LEVELS * RATIO_BINS, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_TOGETHER):
                q, _ = _opened(batch.column(0).slice(lo, ROWS_TOGETHER))
                total += np.bincount(model.left_level[q[1]] * RATIO_BINS + model.ratio_bins(*q), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // RATIO_BINS), pa.array(at % RATIO_BINS), pa.array(total[at])], ["level", "bin", "n"])

    return gather


def _scorer(model: Interpolated):
    """Appends the score to rows whose first column has the levels."""

    def score(batches):
        for batch in batches:
            got = []
            for lo in range(0, batch.num_rows, ROWS_TOGETHER):
                q, first = _opened(batch.column(0).slice(lo, ROWS_TOGETHER))
                got.append(np.add.reduceat(model.log10(*q), first[:-1]))
            got = pa.array(np.concatenate(got) if got else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], [*batch.schema.names[1:], "score"])

    return score


def lm_scores(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    The model is learnt from the texts of ``train``, a frame, or of the rows of ``docs`` where
    ``train``, a condition, holds.  Null texts count as empty; an empty text is its end alone;
    repeated rows are scored alike; with no training text every token has probability
    1 / (V + 1) = 1.  Other columns are not read.
    """
    spark, sc = docs.sparkSession, Scratch(docs.sparkSession, "lm-score")
    text = F.col(text_col).cast("string").alias("text")
    if isinstance(train, Column):
        flags = F.when(train, LEARN + TELL).otherwise(TELL)
        texts = docs.select(F.col(id_col).cast("long").alias("id"), flags.cast("int").alias("flags"), text)
    else:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(TELL).alias("flags"), text)
        texts = texts.union(train.select(F.lit(None).cast("long").alias("id"), F.lit(LEARN).alias("flags"), text))
    seg = F.shiftrightunsigned("key", 52).alias("seg")
    learns = F.col("flags").bitwiseAND(LEARN) != 0
    counts = texts.where(learns).select("text").mapInArrow(_counter, "key long, n long").repartition(seg).groupBy(seg, "key").agg(F.sum("n").alias("n"))
    built = sc.keep(counts.sortWithinPartitions("seg").select("key", "n").mapInArrow(_builder, "seg int, bits binary, size long, words array<long>, counts array<long>, mass double"))
    words = built.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    size = built.agg(F.sum("size").alias("size"), F.sum("mass").alias("mass"), F.sum(F.size("words").cast("long")).alias("types"),
                     F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    tokens, types = size["tokens"] or 0, size["types"] or 0
    model = Interpolated(size["mass"] or 0.0, types, np.ones(MOST_LEVELS))

    top = words.where(F.col("c") * HEAVY >= tokens).toArrow()
    order = np.argsort(top["word"].to_numpy().view(np.uint64))
    logs = np.log10((top["c"].to_numpy()[order] + 1) / (tokens + types + 1)) if tokens else np.zeros(0)
    heavy = spark.sparkContext.broadcast((top["word"].to_numpy().view(np.uint64)[order], logs))

    if (size["size"] or 0) <= max_filter_bytes:
        # one copy of the bits beside the rows they come in
        whole = bytearray(size["size"] or 0)
        offsets = np.zeros(SEGMENTS + 1, np.int64)
        sizes = {r.seg: r.size for r in built.select("seg", "size").collect()}
        offsets[np.array(list(sizes), np.int64) + 1] = [x // 8 for x in sizes.values()]
        offsets = np.cumsum(offsets)
        for r in built.select("seg", "bits").toLocalIterator():
            place = 8 * int(offsets[r.seg])
            whole[place : place + len(r.bits)] = r.bits
        source = _probed(spark.sparkContext.broadcast((offsets, bytes(whole))))
        del whole
    else:
        source, texts = _routed, _with_levels(sc, texts, built)
    # texts are read and probed once; the weights and the scores need their levels only
    read = sc.keep(texts.mapInArrow(_reader(source, heavy), _READ))
    found = read.where(learns).select("levels").mapInArrow(_gatherer(model), "level long, bin long, n long")
    model.weights = fit_weights(found.groupBy("level", "bin").agg(F.sum("n").alias("n")).collect())

    told = read.where(F.col("flags").bitwiseAND(TELL) != 0)
    rare = told.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    light = words.where(F.col("c") * HEAVY < tokens)
    total = float(tokens + types + 1)
    rare = rare.join(light, "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(total))).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0)
    scored = told.select("levels", "uid", "id", "n_tokens", "heavy_tokens", "heavy_base").mapInArrow(_scorer(model), "uid long, id long, n_tokens long, heavy_tokens long, heavy_base double, score double")
    return scored.join(rare, "uid", "left").select(
        "id", "n_tokens", (F.col("heavy_tokens") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("heavy_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the rows whose crc32 of the id modulo 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = lm_scores(docs, ~held_out("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")
    return out.withColumn("held_out", held_out("doc_id", 7, 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
