"""What quality filters take from each other, for every order of applying them.

Text columns are scanned as Arrow hands them over: one buffer of bytes and the rows' offsets.
A table of byte classes and prefix sums give words, capitals, symbols and code points of all
rows of a window at once.  Words get 64-bit hashes from one prefix sum of weighted bytes; each
row's hashes are sorted, neighbours with equal hashes are compared byte by byte, and a row in
which different words share a hash is counted with a set instead.  A row becomes a mask of the
filters that it fails, and masks are reduced to counts by part before any order is looked at,
so the 120 orders of five filters cost nothing over the corpus.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import mix

#: bytes scanned at once; a longer row is scanned in windows cut between words
WINDOW = 1 << 18
#: rows in a window
WINDOW_ROWS = 1 << 14

FILTERS = "ABCDE"

_CAPITAL, _SYMBOL, _INNER = 1, 2, 4
_code = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 256, dtype=np.uint64)
_base = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(WINDOW, _base, np.uint64))))
    _down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(WINDOW, pow(_base, -1, 2**64), np.uint64))))


@dataclass(frozen=True)
class Limits:
    """Where the filters fail a text: A few words, B few distinct ones, C many capitals, D any symbol, E a copy."""

    min_words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    symbols: str = "#$%&*|"


def _classes(symbols: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("A") : ord("Z") + 1] |= _CAPITAL
    table[list(symbols.encode("ascii"))] |= _SYMBOL
    table[0x80:0xC0] |= _INNER
    return table


_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _windows(buf: np.ndarray, at: np.ndarray):
    """(first row, rows, lo, hi): whole rows of at most ``WINDOW`` bytes together, or a piece of a longer row.

    A long row is cut before a word; a word of ``WINDOW`` bytes or more is a piece by itself.
    """
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] <= WINDOW:
            j = min(int(np.searchsorted(at, at[i] + WINDOW, "right")) - 1, i + WINDOW_ROWS, n)
            yield i, j - i, int(at[i]), int(at[j])
            i = j
            continue
        lo, end = int(at[i]), int(at[i + 1])
        while lo < end:
            hi = min(lo + WINDOW, end)
            if hi < end:
                gaps = np.flatnonzero(~_WORD[buf[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:
                    while hi < end and _WORD[buf[hi]]:
                        step = np.flatnonzero(~_WORD[buf[hi : hi + WINDOW]])
                        hi = min(end, hi + (int(step[0]) if len(step) else WINDOW))
            yield i, 0, lo, hi
            lo = hi
        i += 1


def _words(buf: np.ndarray, lo: int, hi: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in the whole buffer) and hash of the words of a window; ``starts`` are its rows' places."""
    piece = buf[lo:hi]
    word = _WORD[piece]
    first = word.copy()
    first[1:] &= ~word[:-1]
    rows = starts[(starts >= lo) & (starts < hi)] - lo
    first[rows] |= word[rows]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = rows[rows > 0] - 1
    last[before] |= word[before]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(piece) > WINDOW:
        own = [int.from_bytes(hashlib.blake2b(piece[x:y].tobytes(), digest_size=8).digest(), "little") for x, y in zip(a, b, strict=True)]
        return a + lo, b + lo, np.array(own, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_code[piece] * _up[: len(piece)], dtype=np.uint64)))
        h = mix((sums[b] - sums[a]) * _down[a] + (b - a).astype(np.uint64))
    return a + lo, b + lo, h


def _same_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at x and at y are alike, for each pair."""
    out = np.ones(len(x), bool)
    stop = np.cumsum(size)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + WINDOW, "right")))
        n = size[lo:hi]
        if hi == lo + 1 and n[0] > WINDOW:
            out[lo] = buf[x[lo] : x[lo] + n[0]].tobytes() == buf[y[lo] : y[lo] + n[0]].tobytes()
        else:
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = buf[np.repeat(x[lo:hi], n) + step] != buf[np.repeat(y[lo:hi], n) + step]
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), differ, hi - lo) == 0
        lo = hi
    return out


def distinct_words(buf: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct words of each row, whose words are those from ``first[i]`` to ``first[i + 1]``."""
    order = np.concatenate([np.zeros(0, np.int64), *(lo + np.argsort(h[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True))])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    twin = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (row[1:] == row[:-1]))
    x, y = order[twin], order[twin + 1]
    size = b[x] - a[x]
    same = size == b[y] - a[y]
    same[same] = _same_bytes(buf, a[x[same]], a[y[same]], size[same])
    out = np.diff(first) - np.bincount(row[twin], minlength=len(first) - 1)
    for i in np.unique(row[twin[~same]]):
        mine = slice(first[i], first[i + 1])
        out[i] = len({buf[s:e].tobytes() for s, e in zip(a[mine], b[mine], strict=True)})
    return out


def scan(texts: pa.Array, symbols: str = Limits.symbols) -> tuple[np.ndarray, list[bytes]]:
    """Rows of (words, distinct words, capitals, symbols, code points), and the SHA-256 of each text."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    table, out = _classes(symbols), np.zeros((len(texts), 5), np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, rows, lo, hi in _windows(buf, at):
        if hi > lo:
            kind = table[buf[lo:hi]]
            cut = (at[i : i + rows + 1] if rows else np.array([lo, hi])) - lo
            span = slice(i, i + max(rows, 1))
            for column, bit in ((2, _CAPITAL), (3, _SYMBOL), (4, _INNER)):
                sums = np.concatenate((np.zeros(1, np.int32), np.cumsum((kind & bit) != 0, dtype=np.int32)))
                out[span, column] += np.diff(sums[cut])
            out[span, 4] -= np.diff(cut)
            a, b, h = _words(buf, lo, hi, at[i : i + rows] if rows else np.zeros(0, np.int64))
            if rows:
                first = np.searchsorted(a, at[i : i + rows + 1])
                out[span, 0] = np.diff(first)
                out[span, 1] = distinct_words(buf, a, b, h, first)
            else:
                held.append((a, b, h))
        if not rows and hi == at[i + 1]:
            a, b, h = (np.concatenate(x) for x in zip(*held, strict=True))
            out[i, 0], out[i, 1] = len(a), distinct_words(buf, a, b, h, np.array([0, len(a)]))[0]
            held = []
    out[:, 4] *= -1
    view = memoryview(buf)
    return out, [hashlib.sha256(view[x:y]).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def document_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", symbols: str = Limits.symbols) -> DataFrame:
    """(id, part, words, distinct, capitals, symbols, points, digest) for each row of ``docs``.

    Words are maximal stretches of characters other than ``\\x20`` and ``\\x09-\\x0D``; capitals are A-Z.
    A null text is an empty one, a null part the empty string; rows with a null or repeated id
    are each counted; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["words", "distinct", "capitals", "symbols", "points"]

    def run(batches):
        for batch in batches:
            counts, digests = scan(batch.column(2), symbols)
            columns = [pa.array(counts[:, k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(digests, pa.binary())], ["id", "part", *names, "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, part string, {', '.join(f'{n} long' for n in names)}, digest binary")


def _own_mask(limits: Limits) -> Column:
    """Bits of the filters that a text fails by itself: A is 1, B 2, C 4, D 8."""
    tests = [
        F.col("words") < limits.min_words,
        100 * F.col("distinct") < limits.distinct_percent * F.col("words"),
        100 * F.col("capitals") > limits.capital_percent * F.col("points"),
        F.col("symbols") > 0,
    ]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of ``mask``.

    Copies (bit 16) are rows whose id is greater than that of another row with the same text
    (texts are the same where their SHA-256 is).  Rows with a null id are no copies and make none;
    repeated rows have one id, so none is a copy of the other.  A label holds if any row of
    ``labels`` for the id says 1; ids without labels are neither good nor toxic.
    Rows are merged before each shuffle, so a text or an id that a third of the table shares
    arrives as one row from each task.
    """
    marks = document_marks(docs, id_col, text_col, part_col, limits.symbols)
    rows = marks.groupBy("id", "digest", "part", _own_mask(limits).alias("mask")).agg(F.count("*").alias("n"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # rows without an id meet no label, and their texts tell them apart, so that they spread over the tasks
    keys = F.col("id").isNull().alias("nameless"), F.coalesce(F.col("id").cast("string"), F.hex("digest")).alias("key")
    said = said.select(F.lit(False).alias("nameless"), F.col("id").cast("string").alias("key"), "good", "toxic")
    known = rows.select("*", *keys).join(said, ["nameless", "key"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # of each text in each part: its rows, its smallest id, and the rows that have that id
    named = ~F.col("nameless")
    texts = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("n_nameless"), F.min(F.when(named, F.struct("id", "n"))).alias("least"))
    least = texts.groupBy("digest").agg(F.min("least.id").alias("least_id"))
    first = F.col("n_nameless") + F.when(F.col("least.id") == F.col("least_id"), F.col("least.n")).otherwise(0)
    all_rows = texts.join(least, "digest").select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))).alias("x")
    ).select("part", "x.mask", "x.n", "good", "toxic")
    return all_rows.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def every_order(counts: DataFrame) -> DataFrame:
    """The audit's rows from (part, mask, n, good, toxic): each part, order of the filters and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(FILTERS[x] for x in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(earlier).alias("earlier"), F.lit(1 << f).alias("bit")))
            earlier |= 1 << f
    rows = counts.select("*", F.explode(F.array(*steps)).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(what: Column | str, where: Column, name: str) -> Column:
        return F.sum(F.when(where, what).otherwise(0)).cast("long").alias(name)

    # among the k filters that a document fails each is first in 120 / k of the orders
    turns = F.lit(120) / F.bit_count("mask")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~fails & ~gone, "kept"),
        total(F.col("n"), fails & ~gone, "removed"),
        total(F.col("n"), fails & gone, "redundant"),
        total(F.col("n"), F.col("mask") == F.col("bit"), "unique_fails"),
        total(F.col("good"), fails & ~gone, "good_lost"),
        total(F.col("toxic"), fails & ~gone, "toxic_lost"),
        F.sum(F.when(fails, (F.col("n") * turns).cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    600 rows for each part that has a document, zeros included; none for an empty table.  See
    ``document_marks`` and ``mask_counts`` for nulls, repeated rows and labels.
    """
    return every_order(mask_counts(docs, labels, limits, id_col, text_col, part_col))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit(docs, labels)


OP13_SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
words as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts),
least as (select text, min(doc_id) as least_id from texts group by text),
flags as (
  select part,
    (case when len(w) < 100 then 1 else 0 end)
    + (case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end)
    + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > least_id then 16 else 0 end) as mask,
    coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
  from words join least using (text) left join labels using (doc_id)),
masks as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from flags group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (
  select filter_order, s.step::int as step, bits[s.step] as bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::int as earlier
  from orders, (select unnest(range(1, 6)) as step) s),
places as (select s.*, m.* from steps s, masks m),
audit as (
  select part, filter_order, step, bit,
    sum(case when mask & (earlier + bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & bit > 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit > 0 and mask & earlier > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit > 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & bit > 0 and mask & earlier = 0 then toxic else 0 end)::bigint as toxic_lost
  from places group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from audit
"""
