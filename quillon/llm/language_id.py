"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled: affix, byte n-gram and lexicon features (hashed) give its
emissions, learnt transitions join neighbouring words, and forward-backward gives each
word's marginals, so that code-switched text is labelled word by word.  A text's language
is the one with the largest length-weighted mean marginal.  The field is trained by
gradient ascent on its log-likelihood over sequences spliced from training texts of
different languages, which is where the transitions learn how languages change.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out
from .textkit import Words, blocks

HASH_BITS = 17
#: the training sample: so many texts of each language, none longer than this many characters
TRAIN_PER_LANG, TRAIN_CHARS = 300, 12_000
#: words that one forward-backward pass joins
SEGMENT = 48
UNDETERMINED = "und"

_GAP = np.ones(256, bool)
_GAP[[*range(0x61, 0x7B), *range(0x80, 0x100), 0x27]] = False
_LETTER = re.compile(r"[^\W\d_]")
AFFIXES = (1, 2, 3, 4)


def features(w: Words, pick: np.ndarray):
    """(word, feature, weight) triples of the picked words, as three arrays; features are hashed."""
    start, end = w.start[pick], w.end[pick]
    size = end - start
    mask = np.uint64((1 << HASH_BITS) - 1)
    at, feat, weight = [np.arange(len(pick))], [w.hash[pick] & mask], [np.ones(len(pick))]
    for k in AFFIXES:
        ok = np.flatnonzero(size >= k)
        for seed, (s, e) in enumerate(((start[ok], start[ok] + k), (end[ok] - k, end[ok]))):
            at.append(ok)
            feat.append(((w.span_hash(s, e) >> np.uint64(7 * seed + 3)) + np.uint64(1000 * k + seed)) & mask)
            weight.append(np.full(len(ok), 0.7))
    grams = np.maximum(0, size - 2)
    owner = np.repeat(np.arange(len(pick)), grams)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    s = start[owner] + offset
    at.append(owner)
    feat.append(((w.span_hash(s, s + 3) >> np.uint64(29)) + np.uint64(77)) & mask)
    weight.append(1 / np.sqrt(np.maximum(1, grams))[owner])
    return np.concatenate(at), np.concatenate(feat).astype(np.int64), np.concatenate(weight)


@dataclass
class Field:
    """Languages, emission weights (features x languages) and transition scores."""

    langs: list[str]
    emit: np.ndarray
    trans: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Emission scores of each word, computed once for each distinct one."""
        _, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at, feat, weight = features(w, pick)
        n = len(pick)
        scores = np.column_stack([np.bincount(at, self.emit[feat, k] * weight, n) for k in range(len(self.langs))])
        return scores[back]


def forward_backward(emit: np.ndarray, valid: np.ndarray, trans: np.ndarray):
    """Marginals (s, t, l) and summed pair marginals (l, l) of padded sequences, in scaled probabilities."""
    s, t, n = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    e[~valid] = 1
    m = np.exp(trans)
    ahead, back = np.empty_like(e), np.empty_like(e)
    a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = a
    for i in range(1, t):
        new = (a @ m) * e[:, i]
        new /= new.sum(1, keepdims=True)
        a = np.where(valid[:, i, None], new, a)
        ahead[:, i] = a
    b = np.full((s, n), 1.0 / n)
    back[:, t - 1] = b
    for i in range(t - 1, 0, -1):
        new = (e[:, i] * b) @ m.T
        new /= new.sum(1, keepdims=True)
        b = np.where(valid[:, i, None], new, b)
        back[:, i - 1] = b
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    return p, ahead, back, e, m


def _pairs(ahead, back, e, m, valid):
    """Expected transitions summed over all sequences."""
    total = np.zeros_like(m)
    for i in range(1, e.shape[1]):
        x = ahead[:, i - 1, :, None] * m[None] * (e[:, i] * back[:, i])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        total += x[valid[:, i]].sum(0)
    return total


def train(rows: list[tuple[str, str]], epochs: int = 2, rate: float = 0.5, seed: int = 7) -> Field | None:
    """Fit the field to (text, language) rows; None without any labelled word."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    w = Words([t.lower().encode("utf-8", "surrogatepass") for t, _ in rows], space=_GAP)
    n = len(langs)
    field = Field(langs, np.zeros((1 << HASH_BITS, n)), np.zeros((n, n)))
    if not len(w.hash):
        return field
    label = np.repeat([langs.index(lang) for _, lang in rows], w.counts())
    # runs of 3 to 16 words, shuffled, so that neighbours in a sequence change language
    cuts, at = [], 0
    while at < len(label):
        cuts.append(at)
        at += int(rng.integers(3, 17))
    runs = [np.arange(a, b) for a, b in zip(cuts, [*cuts[1:], len(label)], strict=True)]
    squares, tsquares = np.full_like(field.emit, 1e-2), np.full((n, n), 1e-1)
    for _ in range(epochs):
        order = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
        for lo in range(0, len(order), 256 * SEGMENT):
            some = order[lo : lo + 256 * SEGMENT]
            pad = -len(some) % SEGMENT
            valid = (np.arange(len(some) + pad) < len(some)).reshape(-1, SEGMENT)
            at, feat, weight = features(w, some)
            score = np.column_stack([np.bincount(at, field.emit[feat, k] * weight, len(some)) for k in range(n)])
            emit = np.concatenate((score, np.zeros((pad, n)))).reshape(-1, SEGMENT, n)
            p, ahead, back, e, m = forward_backward(emit, valid, field.trans)
            y = label[some]
            grad = -p.reshape(-1, n)[: len(some)]
            grad[np.arange(len(some)), y] += 1
            grad /= len(some)
            ids, inverse = np.unique(feat, return_inverse=True)
            step = np.column_stack([np.bincount(inverse, grad[at, k] * weight, len(ids)) for k in range(n)])
            squares[ids] += step**2
            field.emit[ids] += rate * step / np.sqrt(squares[ids])
            seen = np.zeros((n, n))
            both = valid.reshape(-1)[: len(some)].copy()
            both[::SEGMENT] = False
            nxt = np.flatnonzero(both)
            np.add.at(seen, (y[nxt - 1], y[nxt]), 1)
            tstep = (seen - _pairs(ahead, back, e, m, valid)) / len(some)
            tsquares += tstep**2
            field.trans += rate * tstep / np.sqrt(tsquares)
    return field


def label_words(field: Field, w: Words) -> np.ndarray:
    """Marginals of each word; a text's words are cut into segments of ``SEGMENT``."""
    n = len(field.langs)
    count = w.counts()
    segments = -(-count // SEGMENT)
    base = np.repeat(np.cumsum(segments) - segments, count) * SEGMENT
    place = base + np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
    size = int(segments.sum()) * SEGMENT
    emit, valid = np.zeros((size, n)), np.zeros(size, bool)
    emit[place], valid[place] = field.emissions(w), True
    p = forward_backward(emit.reshape(-1, SEGMENT, n), valid.reshape(-1, SEGMENT), field.trans)[0]
    return p.reshape(-1, n)[place]


def _labeller(field: Field | None):
    def predict(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score, switched = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            letters = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
            for at, group in blocks([t.lower() if t else t for t in texts]) if field else ():
                w = Words(group, space=_GAP)
                if not len(w.hash):
                    continue
                p = label_words(field, w)
                size = (w.end - w.start).astype(float)
                sums = np.vstack((np.zeros(p.shape[1]), np.cumsum(p * size[:, None], 0)))
                top = np.concatenate(([0], np.cumsum(p.argmax(1)[1:] != p.argmax(1)[:-1]), [0]))
                weight = np.concatenate(([0], np.cumsum(size)))
                for i in range(len(group)):
                    lo, hi = w.first[i], w.first[i + 1]
                    if letters[at + i] and hi > lo:
                        share = (sums[hi] - sums[lo]) / (weight[hi] - weight[lo])
                        best = int(share.argmax())
                        lang[at + i], score[at + i] = field.langs[best], min(1.0, share[best])
                        switched[at + i] = top[hi - 1] - top[lo]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(switched.astype(np.int64))],
                ["id", "lang_pred", "score", "switches"],
            )

    return predict


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``TRAIN_PER_LANG`` texts of each language, by a hash of the id, from the training fold."""
    fold = docs.where(~held_out(id_col, 4, 2) & F.col(lang_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS) & (F.length(F.trim(F.col(text_col))) > 0))
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col, F.xxhash64(text_col))
    picked = fold.select(id_col, lang_col, text_col).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= TRAIN_PER_LANG)
    return [(r[text_col], r[lang_col]) for r in picked.orderBy(lang_col, "rn").collect()]


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, switches) for each row of ``docs``.

    Training rows are those whose crc32 of the id modulo 4 is not 2, with a language and a
    text of at most ``TRAIN_CHARS`` characters.  Null texts and texts without a letter, and
    every text where nothing could be learnt, are ``und`` with score 0.  ``switches`` counts
    the places where neighbouring words have different languages.  Repeated rows are
    labelled alike; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    field = train(training_sample(rows, "id", "text", "lang"))
    out = rows.select("id", "text").mapInArrow(_labeller(field), "id long, lang_pred string, score double, switches long")
    return out.select("id", held_out("id", 4, 2).alias("held_out"), "lang_pred", "score", "switches")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict_language(docs).withColumnRenamed("id", "doc_id")
