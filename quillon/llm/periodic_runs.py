"""Periodic runs of words: divide and conquer over each text's interned words.

A text is halved at a midpoint again and again.  A repetition that crosses a midpoint with
period q shows as two agreements with itself moved by q: one going on from the midpoint, one
going back from it.  Z-functions of the halves give both for all q at once, so a run's ends
follow without any search.  At least half of a period, beyond the first, lies on one side,
which leaves few periods to look at: positions whose word equals the one at the midpoint.
A run belongs to the highest midpoint that cuts it; what a node's border cuts off is left to
the node above.  Intervals found with several periods keep the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 24
MIN_POWER = 3

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def z_function(s: list[int], where: list[int]) -> dict[int, int]:
    """Length of the longest common prefix of ``s`` and ``s[i:]`` for i in ``where``.

    ``where`` lists, in order, all positions but 0 that hold the first word; elsewhere it is 0.
    """
    z: dict[int, int] = {}
    n, left, right = len(s), 0, 0
    for i in where:
        k = min(right - i, z.get(i - left, 0)) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(back: np.ndarray, ahead: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, reach back, reach ahead) of repetitions with most of their words ahead of a midpoint.

    ``ahead`` are the words from the midpoint on, ``back`` those before it, nearest first.  A
    repetition of three periods has one and a half of them on one of its sides; call this with
    the sides swapped for the others.
    """
    where = (np.flatnonzero(ahead[1:] == ahead[0]) + 1).tolist()
    if not where:
        return []
    on = z_function(ahead.tolist(), where)
    periods = [q for q in where if 2 * on[q] >= q]
    if not periods:
        return []
    if not len(back):
        return [(q, 0, q + on[q]) for q in periods]
    most = periods[-1]
    # reading back from q words ahead of the midpoint, against reading back from the midpoint
    w = np.concatenate((back, [-1], ahead[:most][::-1], back))
    off = z_function(w.tolist(), (np.flatnonzero(w[1:] == w[0]) + 1).tolist())
    return [(q, off.get(len(back) + 1 + most - q, 0), q + on[q]) for q in periods]


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of interned words, by start, then period.

    ``min_power`` is 3 or more: a run has that many periods and ``min_length`` words at least.
    """
    if min_power < 3:
        raise ValueError("runs of less than three periods may have no side with one and a half of them")
    n, found, nodes = len(words), {}, [(0, len(words))]
    while nodes:
        lo, hi = nodes.pop()
        if hi - lo < max(min_length, min_power):
            continue
        mid = (lo + hi) // 2
        nodes += [(lo, mid), (mid, hi)]
        ahead, back = words[mid:hi], words[lo:mid][::-1]
        spans = [(q, mid - b, mid + a) for q, b, a in crossing(back, ahead)]
        spans += [(q, mid - a, mid + b) for q, b, a in crossing(ahead, back)]
        for q, start, end in spans:
            if end - start < max(min_length, min_power * q):
                continue
            if start == lo > 0 and words[lo - 1] == words[lo - 1 + q] or end == hi < n and words[hi] == words[hi - q]:
                continue
            found[start, end] = min(q, found.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def _scan(min_length: int, min_power: int):
    schema = pa.schema(
        [
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            ("collapsed", pa.string()),
        ]
    )

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for value in batch.column(1):
                words = value.as_py().encode("utf-8", "surrogatepass").split() if value.is_valid else []
                runs: list[tuple[int, int, int]] = []
                if len(words) >= min_length:
                    ids: dict[bytes, int] = {}
                    runs = find_runs(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64), min_length, min_power)
                kept = words
                if runs:
                    kept = [w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k]
                out[0].append(len(words))
                out[1].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                out[2].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            arrays = [pa.array(x, f.type) for x, f in zip(out, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *schema.names])

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_power: int = MIN_POWER
) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row of ``docs``; ids keep their type.

    Words are maximal stretches of characters other than ``\\x20`` and ``\\x09-\\x0D``, numbered from
    0; nothing is lower-cased.  ``runs`` holds start, length and smallest period, by start, then
    period; ``collapsed`` is the text without what repeats a run's first period, its words joined
    by one space.  A null text is an empty one: no words, no runs, an empty ``collapsed``.  Rows
    with a null or repeated id are each handled; other columns are not read.  A text is one row and
    costs about its length times the logarithm of that, however repetitive it is.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(min_length, min_power), f"id {id_type}, n_words bigint, runs {RUNS}, collapsed string")


def longest_repeat(runs: str) -> Column:
    """The run with the greatest exact length / period; ties go to the smaller start, then period."""

    def order(x: Column, y: Column) -> Column:
        mine, other = x["length"] * y["period"], y["length"] * x["period"]
        by_place = F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
        return F.when(mine > other, -1).when(mine < other, 1).otherwise(by_place)

    return F.get(F.array_sort(runs, order), F.lit(0))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of which one in ten (by crc32 of the id) repeats itself from some word on; others as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = docs.select(id_col, text_col, h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    planted = F.expr(
        """
        transform(array(named_struct('n', cast(size(_w) as bigint), 'g', _h div 10)), x ->
          transform(array(named_struct('a', x.g % x.n, 'p', 1 + (x.n - x.g % x.n) div (3 + x.g % 8))), y ->
            array_join(transform(_w, (w, i) -> if(i < y.a, w, _w[cast(y.a + (i - y.a) % y.p as int)])), ' '))[0])[0]
        """
    )
    return changed.select(id_col, F.when(F.size("_w") > 0, planted).otherwise(F.col(text_col)).alias(text_col))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, the most repetitive one, and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", longest_repeat("runs"))
    line = "concat(r.start, ',', r.length, ',', r.period, '\\n')"
    lines = F.expr(f"array_join(transform(runs, r -> {line}), '')")
    best = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
