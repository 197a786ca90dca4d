"""N-gram Jaccard join over a count-vector R-tree.

A document's set is its distinct k-word shingles.  Two documents link when
``den * |A & B| >= num * |A | B|``.

Method.  Shingles are hashed into groups and a set is the point of its group counts.  Points
are routed down a tree.  Its root parts the sizes into bands (a set goes to its own and to those
of larger partners).  For linked sets the L1 distance of their points is at most
``tau = floor(2 n (den - num) / (den + num))``, n the larger size, and boxes cut at medians
cannot prune such a radius in many dimensions (a point's distance to a box is far below tau).
So the next level fans out by the pigeonhole principle: the groups of a band are dealt into
tau + 1 + spare blocks, at most tau of which can differ, so linked points agree exactly on at
least one block's counts.  A child is a box without extent in the coordinates of one block: a
cell, named by (band, block, block counts), one shuffle key.  Below a cell, points are packed
bottom-up into nodes of ``NODE`` with upper corners and ranges of size, level upon level; a probe
descends where the sizes may link and the sum over coordinates of the minima of corner and point
reaches the overlap that a link needs.  A pair that two points give, and any pair before its
sets are compared, takes the same bound, and survivors are verified on the exact sets.

Spare blocks make linked points agree on several cells, ``least`` of them at least.  So a
class that shares fewer cells goes, and every class may leave its hottest ``least - 1`` cells,
hottest by one order for all: linked classes still meet in the coolest one they share.

No link is lost: cells are complete, the bound never underestimates, verification is
exact on 64-bit shingle hashes.  Sets that are equal are one class (64-bit digest of the
set) from the first pass on, so copies never meet as pairs.  Cells are first linked to
their smallest member only; pairs are enumerated afterwards just between members of a cell
that those links left in different components, in chunks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .textkit import Words, blocks, mix, shingle_hashes

BAND_RATIO = 1.5
#: one spare block for so many that may differ
SPARE = 5
GROUPS_PER_BLOCK = 1 << 16
#: members of a cell that one task compares at once
CHUNK = 512
NODE = 32
#: texts of a batch that are taken out of it together
TEXTS = 512
#: a member carries at most so many groups of its point, and so many of its cells
POINT_GROUPS, CARRIED = 128, 4
#: groups whose counts bound a pair's overlap before its sets are compared; divides the groups of any point
BOUND_GROUPS = 32
#: bits of the broadcast bitmaps of candidate documents and of shared cells (8 and 16 MB whatever the input)
BITMAP_BITS, CELL_BITS = 1 << 26, 1 << 27


def tau(n: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets, the larger of size n."""
    return 2 * n * (den - num) // (den + num)


def bands(limit: int, num: int, den: int) -> list[tuple[int, int]]:
    """(first size, number of blocks) of each band up to ``limit``; spare blocks bear empty ones."""
    out, low = [], 1
    while low <= limit:
        high = max(low + 1, math.ceil(low * BAND_RATIO))
        while tau(high, num, den) == tau(low, num, den):
            high += 1
        t = tau(high - 1, num, den)
        out.append((low, t + 1 + t // SPARE))
        low = high
    return out


def cell_keys(u: np.ndarray, table: list[tuple[int, int]], starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Leaf cells of the set ``u``, for its own band and for each with larger partners, and how many of them
    a linked set shares at least."""
    n, out, least = len(u), [], None
    first = int(np.searchsorted(starts, n, "right")) - 1
    last = int(np.searchsorted(starts, n * den // num, "right")) - 1
    for band in range(first, last + 1):
        low, count = table[band]
        spare = count - 1 - tau(max(low, int(starts[band + 1]) - 1), num, den)
        a = mix(u, 101 + band)
        block = (a % np.uint64(count)).astype(np.int64)
        with np.errstate(over="ignore"):
            # the sum of a code per group names the block's multiset of groups: its counts
            code = mix((a >> np.uint64(32)) % np.uint64(GROUPS_PER_BLOCK), 77)
            order = np.argsort(block, kind="stable")
            b = block[order]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            sums, which = np.add.reduceat(code[order], cut), b[cut]
            # empty blocks count among those that agree; they are no cells while other ones remain
            here = spare + 1 - (count - len(which))
            if here < 1:
                missing = np.setdiff1d(np.arange(count), which)
                sums, which = np.concatenate((sums, np.zeros(len(missing), np.uint64))), np.concatenate((which, missing))
                here = 1
            least = here if least is None else min(least, here)
            out.append(mix(sums + mix(which.astype(np.uint64), 7 + band), 3))
    return np.concatenate(out), least


def point(u: np.ndarray) -> bytes:
    """Group counts, a byte each where they fit; the groups are about half of the size and a power of two, so that points fold."""
    size = min(POINT_GROUPS, max(64, 1 << max(0, math.ceil(math.log2(max(1, len(u)) / 2)))))
    c = np.bincount((mix(u, 5) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return b"1" + c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b"4" + c.astype(np.int32).tobytes()


def _opened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[:1] == b"1" else np.int32, offset=1).astype(np.int32)


def _sets(batch: pa.RecordBatch, k: int):
    """(row, distinct sorted shingle hashes) of each text; the texts of a batch are taken out a few at a time."""
    for lo in range(0, batch.num_rows, TEXTS):
        for at, group in blocks(batch.column(1).slice(lo, TEXTS).to_pylist()):
            w = Words(group)
            for i in range(len(group)):
                yield lo + at + i, np.unique(shingle_hashes(w.hash[w.first[i] : w.first[i + 1]], k))


def _digest(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix(np.array([mix(u, 11).sum(dtype=np.uint64)]), len(u)))[0].view(np.int64))


def _sketcher(k: int, num: int, den: int):
    def sketch(batches):
        table = bands(1 << 12, num, den)
        starts = np.array([x[0] for x in table])
        for batch in batches:
            n, cls, keys, least, seen = [], [], [], [], set()
            for _, u in _sets(batch, k):
                if len(u) * den // num >= starts[-1]:
                    table = bands(4 * len(u), num, den)
                    starts = np.array([x[0] for x in table])
                c = _digest(u) if len(u) else None
                n.append(len(u))
                cls.append(c)
                # a copy within the batch has sent its cells already
                k_least = (np.zeros(0, np.uint64), None) if c is None or c in seen else cell_keys(u, table, starts, num, den)
                keys.append(k_least[0].view(np.int64))
                least.append(k_least[1])
                seen.add(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(least, pa.int32())],
                ["id", "n", "cls", "keys", "least"],
            )

    return sketch


def _expander(k: int, bitmap):
    def expand(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = batch.filter(pa.array(_hit(bits, ids)))
            rows = [(_digest(u), len(u), u.view(np.int64), point(u)) for _, u in _sets(some, k) if len(u)]
            for i in range(0, len(rows), 1000):
                c, n, s, v = zip(*rows[i : i + 1000], strict=True)
                # the bound before the exact comparison takes the counts of fewer groups
                counts = [_opened(x).reshape(-1, BOUND_GROUPS).sum(0) for x in v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int64())), pa.array(v, pa.binary()), pa.array(counts, pa.list_(pa.int32()))],
                    ["cls", "n", "items", "point", "counts"],
                )

    return expand


def _fold(points: list[np.ndarray]) -> np.ndarray:
    size = min(len(p) for p in points)
    return np.stack([p.reshape(-1, size).sum(0) for p in points])


class CountTree:
    """Points packed in the order of their sizes and first counts, with levels of upper corners and size ranges."""

    def __init__(self, v: np.ndarray, n: np.ndarray, num: int, den: int):
        self.v, self.n, self.num, self.den = v, n, num, den
        self.levels, corner, low, high = [], v, n, n
        while len(corner) > 1 and (not self.levels or len(corner) > NODE):
            first = np.arange(0, len(corner), NODE)
            corner, low, high = np.maximum.reduceat(corner, first, 0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.levels.append((corner, low, high))

    def _open(self, corner, low, high, i: int) -> np.ndarray:
        """Whether a box may hold a partner of point i: its sizes may link and the summed minima reach the overlap."""
        n = self.n[i]
        near = (low * self.num <= n * self.den) & (high * self.den >= n * self.num)
        least = np.maximum(low, -(-n * self.num // self.den))
        return near & (np.minimum(corner, self.v[i]).sum(1) * (self.num + self.den) >= self.num * (least + n))

    def probe(self, i: int) -> np.ndarray:
        """Points after i that may link with it."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.n))
        for k in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[k]
            at = at[self._open(corner[at], low[at], high[at], i)]
            at = (at[:, None] * NODE + np.arange(NODE)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.n))]
        at = at[at > i]
        return at[self._open(self.v[at], self.n[at], self.n[at], i)]


def tree_pairs(points: list[np.ndarray], n: np.ndarray, comp: np.ndarray, side: np.ndarray, num: int, den: int):
    """Index pairs (i, j) of different components that may link, by descending the tree with each point.

    ``side``: 0 and 1 for two chunks that meet, pairs then cross; all 0 for one chunk.
    """
    v = _fold(points)
    order = np.lexsort((v[:, 1], v[:, 0], n))
    v, n, comp, side = v[order], n[order], comp[order], side[order]
    tree, cross = CountTree(v, n, num, den), side.any()
    for i in range(len(n) - 1):
        at = tree.probe(i)
        apart = comp[at] != comp[i]
        if cross:
            apart &= side[at] != side[i]
        for j in at[apart]:
            yield int(order[i]), int(order[j])


def _cells(batches):
    """The rows of each (key, i, j), as arrays; a cell may go over batches and has 2 * CHUNK rows or so."""
    names, kept = ("key", "i", "j", "cls", "comp", "chunk", "n", "point", "keys"), None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if kept:
            new = {c: np.concatenate((kept[c], new[c])) for c in names}
        same = (new["key"][1:] == new["key"][:-1]) & (new["i"][1:] == new["i"][:-1]) & (new["j"][1:] == new["j"][:-1])
        cut = np.concatenate(([0], np.flatnonzero(~same) + 1)) if len(new["key"]) else np.zeros(1, int)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield {c: x[lo:hi] for c, x in new.items()}
        kept = {c: x[cut[-1] :] for c, x in new.items()}
    if kept and len(kept["key"]):
        yield kept


def _cell_joiner(num: int, den: int):
    def join(batches):
        a, b = [], []
        for c in _cells(batches):
            if len(c["key"]) < 2 or (c["comp"] == c["comp"][0]).all():
                continue
            side = (c["chunk"] == c["j"][0]).astype(int) if c["i"][0] != c["j"][0] else np.zeros(len(c["key"]), int)
            points = [_opened(x) for x in c["point"]]
            early = None
            for x, y in tree_pairs(points, c["n"], c["comp"], side, num, den):
                if early is None:
                    early = [{k for k in keys if k < c["key"][0]} for keys in c["keys"]]
                if early[x].isdisjoint(early[y]):  # else that cell has the pair
                    p, q = sorted((int(c["cls"][x]), int(c["cls"][y])))
                    a.append(p)
                    b.append(q)
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return join


def _bitmap(spark, ids: DataFrame, size: int):
    """A broadcast bitmap of id modulo ``size``, of a fixed size whatever the number of ids."""
    h = F.coalesce(F.col("id"), F.lit(0)).bitwiseAND(size - 1)
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    )
    got = words.toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy()
    return spark.sparkContext.broadcast(out.tobytes())


def _hit(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & (len(bits) * 64 - 1)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _shared_cells(bitmap):
    """(cls, key) of the cells that the bitmap may hold, of rows (cls, keys)."""

    def pick(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            keys = batch.column(1)
            size = np.diff(keys.offsets.to_numpy())
            flat = keys.flatten().to_numpy()
            hit = _hit(bits, flat)
            owner = np.repeat(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(flat[hit])], ["cls", "key"])

    return pick


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose points pass the bound and whose exact sets link."""
    x, y = (sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"p_{c}"), F.col("items").alias(f"s_{c}")) for c in "ab")
    most = F.aggregate(F.zip_with("p_a", "p_b", lambda g, h: F.least(g, h)), F.lit(0), lambda t, g: t + g).cast("long")
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return (
        pairs.join(x, "a").join(y, "b")
        .where(f"least(n_a, n_b) * {den} >= {num} * greatest(n_a, n_b)")
        .where(most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)
        .withColumn("o", both)
        .where(F.col("o") * den >= (F.col("n_a") + F.col("n_b") - F.col("o")) * num)
        .select("a", "b")
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    component_id is the smallest id among the rows reachable by links, the row itself
    included.  Null, empty and all-space texts have no shingles, link with nothing and
    are their own component; a text of fewer than k words has one shingle.  Repeated rows
    and ids are kept and link through their texts; a null id takes its component's
    smallest id, or null.  Other columns are not read.  ``num / den`` is the similarity.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    spark, sc = docs.sparkSession, scratch or Scratch(docs.sparkSession, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = sc.keep(texts.mapInArrow(_sketcher(k, num, den), "id long, n long, cls long, keys array<long>, least int"))
    cells = sketched.select(F.explode("keys").alias("key"), "cls")

    # cells with several classes, and their members that are in enough of them
    many = cells.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").drop("hi")
    many = sc.keep(many)
    # only cells that may be among them are shuffled; what the bitmap lets through besides, the join drops
    shared = _bitmap(spark, many.select(F.col("key").alias("id")), CELL_BITS)
    cells = sketched.select("cls", "keys").mapInArrow(_shared_cells(shared), "cls long, key long")
    owner = sc.keep(sketched.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.max("least").alias("least")))
    met = cells.join(many, "key").groupBy("cls").agg(F.collect_set(F.struct("key", "lo")).alias("cells"))
    met = met.join(owner, "cls").where(F.size("cells") >= F.col("least"))
    # a class with itself as the smallest of a cell needs others there: they are in the other rows
    members = sc.keep(met.select("cls", "id", "least", "cells"))
    # the cells of all sets are not read again
    whole, sketched = sketched, sc.keep(sketched.select("id", "n", "cls"))
    sc.drop(whole)
    sc.drop(many)
    flat = members.select("cls", "least", F.explode("cells").alias("c")).select("cls", "least", "c.key", "c.lo")
    # links to the smallest class of several cells: these need not be all, they only join what is plainly near
    stars = flat.where("cls <> lo").groupBy(F.col("lo").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("c"), F.max("least").alias("least"))
    stars = stars.where("2 * c >= least").select("a", "b").join(members.select(F.col("cls").alias("a")), "a", "left_semi")

    bits = _bitmap(spark, members.select("id"), BITMAP_BITS)
    sets = texts.mapInArrow(_expander(k, bits), "cls long, n long, items array<long>, point binary, counts array<int>")
    sets = sc.keep(sets.dropDuplicates(["cls"]))
    linked = sc.keep(_verified(stars, sets, num, den))
    label = sc.keep(components(sc, linked))

    # members of one cell that are still apart: any that link share enough cells of this kind
    placed = flat.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "least", F.coalesce("comp", "cls").alias("comp"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x < y")
    rest = placed.join(apart.select("key", "m"), "key").groupBy("cls", "comp", "least").agg(F.collect_list(F.struct("m", "key")).alias("cells"))
    rest = rest.where(F.size("cells") >= F.col("least")).withColumn("cells", F.sort_array("cells", asc=False))
    rest = rest.withColumn("cells", F.slice("cells", F.col("least"), F.size("cells")))
    # a pair that shares several cells is compared in the first of them: members carry their first cells
    rest = sc.keep(rest.withColumn("keys", F.slice(F.sort_array(F.transform("cells", lambda x: x["key"])), 1, CARRIED)))
    spread = rest.select("cls", "comp", F.explode("cells.key").alias("key"))
    size = spread.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    spread = spread.join(size.select("key", "m"), "key").withColumn("c", F.ceil(F.col("m") / CHUNK).cast("int"))
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("c")).cast("int"))
    spread = spread.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    # points join a class once and go to its cells in one shuffle
    place = F.struct("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk")
    spread = spread.groupBy("cls").agg(F.collect_list(place).alias("places")).join(rest.select("cls", "comp", "keys"), "cls").join(sets.select("cls", "n", "point"), "cls")
    cell = ("key", "i", "j")
    spread = spread.select("cls", "comp", "n", "point", "keys", F.explode("places").alias("p")).select("p.key", "p.i", "p.j", "p.chunk", "cls", "comp", "n", "point", "keys")
    spread = spread.repartition(*cell).sortWithinPartitions(*cell).select(*cell, "cls", "comp", "chunk", "n", "point", "keys")
    more = spread.mapInArrow(_cell_joiner(num, den), "a long, b long").distinct()
    more = more.join(stars, ["a", "b"], "left_anti")
    linked2 = sc.keep(_verified(more, sets, num, den))
    label = components(sc, linked.union(linked2))

    # the smallest id of each component, then of each class, as written tables: the joins then are of plain
    # exchanges, of which large parts can be split, however many rows a class or a component has
    members = sc.keep(label.join(owner.select(F.col("cls").alias("node"), "id"), "node"))
    best = sc.keep(members.groupBy("comp").agg(F.min("id").alias("best")))
    best = members.join(best, "comp").select(F.col("node").alias("cls"), "best")
    best = sc.keep(owner.join(best, "cls", "left").select("cls", F.coalesce("best", "id").alias("best")))
    return sketched.join(best, "cls", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("best", "id").alias("component_id"))


def _picker(bitmap, column: int, hit: bool):
    """The rows whose id the bitmap holds, or those whose id it doesn't; a null id counts as 0."""

    def pick(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            ids = batch.column(column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(_hit(bits, ids) == hit))

    return pick


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their component.

    Repeated rows leave one; rows that share an id but not their contents stay or go
    together.  A null id names no document: such rows stay.  Texts without a word stay.
    """
    inner = Scratch(docs.sparkSession, "ngram-join")
    found = jaccard_components(docs, id_col, text_col, k, num, den, inner).where("id is not null")
    found = Scratch(docs.sparkSession, "ngram-groups").keep(found)
    inner.clear()
    # positions, as the columns of docs may have any names
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, same = docs.toDF(*names), F.col(names[docs.columns.index(id_col)]).cast("long") == F.col("id")
    gone = found.where("id <> component_id").select("id").distinct()
    # only rows that may go are shuffled, not all texts
    at = docs.columns.index(id_col)
    bits = _bitmap(docs.sparkSession, gone, BITMAP_BITS)
    maybe, sure = (plain.mapInArrow(_picker(bits, at, hit), plain.schema) for hit in (True, False))
    kept = sure.union(maybe.join(gone, same, "left_anti"))
    twice = found.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id")
    if not twice.isEmpty():
        again = kept.join(twice, same, "left_semi")
        # maps can't be compared: their text stands for them
        maps = {c: f"m{i}" for i, c in enumerate(names) if "map<" in dict(again.dtypes)[c]}
        again = again.withColumns({m: F.to_json(F.array(c)) for c, m in maps.items()}) if maps else again
        again = again.dropDuplicates([maps.get(c, c) for c in names]).select(*names)
        kept = kept.join(twice, same, "left_anti").union(again)
    return kept.toDF(*docs.columns)


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under Jaccard 0.9 on three-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=3, num=90, den=100).withColumnRenamed("id", "doc_id")
