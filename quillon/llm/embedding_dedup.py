"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest pivots in order.  Pivots are vectors of a bounded
sample, spread over the data; their number grows with the root of the number of vectors, so
that lists grow no faster.  Two vectors with a cosine of 0.95 see nearly the same order, so
they share most of their first ``PREFIX`` pivots; the inverted lists are kept for pairs of
pivots, and vectors that meet in a list have a shared-pivot count of at least two.  Every
vector is indexed.  Ids and byte sketches go to the lists first; a bound from the sketches
tells which members of a list may have a partner there, and only those bring their vectors,
for the exact cosine in double precision.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: least and most pivots, the first of each vector's order that it is listed under, and the shared ones asked for
PIVOTS, MOST_PIVOTS, PREFIX, SHARED = 256, 1 << 14, 6, 2
#: sampled vectors for a pivot, and the highest cosine of two pivots: a group of near copies sees one order
SAMPLE, APART = 4, 0.8
#: members of a list that one task compares at once, and vectors whose order a task works out at once
CHUNK, ROWS = 1024, 1024
#: members of a list up to which lists are compared together
FEW = 64


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parse(column: pa.Array, sizes):
    """(rows, vectors) of usable vectors, for each of the sizes: finite, not zero; in double precision."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    if not parts:
        return
    column = pa.concat_arrays(parts)
    start, values = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
    length = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    for dim in sorted(sizes):
        rows = np.flatnonzero(length == dim)
        # a null component is read as no number
        x = values[start[rows][:, None] + np.arange(dim)]
        scale = np.abs(x).max(axis=1, initial=0)
        ok = np.isfinite(scale) & (scale > 0)
        if ok.any():
            yield rows[ok], x[ok] / scale[ok][:, None]


def _order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = -(x @ pivots.T)
    if PREFIX < near.shape[1]:
        some = np.sort(np.argpartition(near, PREFIX - 1, axis=1)[:, :PREFIX], axis=1)
        near = np.take_along_axis(near, some, 1)
        return np.take_along_axis(some, np.argsort(near, axis=1, kind="stable"), 1)
    return np.argsort(near, axis=1, kind="stable")


def _lists(order: np.ndarray, dim: int) -> np.ndarray:
    """List numbers of vectors of one size: one for each pair of their first pivots, in rising order."""
    at = list(combinations(range(order.shape[1]), SHARED))
    if not at:  # one pivot: one list of all
        return np.full((len(order), 1), dim << 32, np.int64)
    a, b = (order[:, [p[k] for p in at]].astype(np.int64) for k in (0, 1))
    return np.sort((np.int64(dim) << 32) + (np.minimum(a, b) << 16) + np.maximum(a, b), axis=1)


def _sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, scale and length of what the bytes leave out, of each row."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def _normaliser(sizes):
    """Vectors of length one, as bytes; null for those that are not usable."""

    def normalise(batches):
        for batch in batches:
            vec = [None] * batch.num_rows
            for rows, x in _parse(batch.column(1), sizes):
                for i, v in zip(rows, normalised(x), strict=True):
                    vec[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["id", "vec"])

    return normalise


MADE = "lists array<long>, sketch binary, scale double, rest double"


def _indexer(pivots: dict[int, np.ndarray]):
    """Adds list numbers and sketches to rows with a column vec."""

    def index(batches):
        for batch in batches:
            made = [[None] * batch.num_rows for _ in range(4)]
            vec = batch.column("vec").to_pylist()
            size = np.array([len(v) // 8 for v in vec], int)
            for dim in np.unique(size):
                of = np.flatnonzero(size == dim)
                for lo in range(0, len(of), ROWS):
                    some = of[lo : lo + ROWS]
                    x = np.frombuffer(b"".join(vec[i] for i in some), float).reshape(len(some), -1)
                    q, scale, rest = _sketch(x)
                    for i, *one in zip(some, _lists(_order(x, pivots[dim]), dim), (y.tobytes() for y in q), scale, rest, strict=True):
                        for column, value in zip(made, one, strict=True):
                            column[i] = value
            types = (pa.list_(pa.int64()), pa.binary(), pa.float64(), pa.float64())
            new = [pa.array(c, t) for c, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lists", "sketch", "scale", "rest"])

    return index


KEY = ("list", "i", "j")


def _whole(batches, names):
    """Columns of whole groups of equal keys, with the places where groups begin and the end."""
    kept = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if kept:
            new = {c: np.concatenate((kept[c], new[c])) for c in names}
        same = np.ones(max(0, len(new["list"]) - 1), bool)
        for c in KEY:
            same &= new[c][1:] == new[c][:-1]
        cut = np.concatenate(([0], np.flatnonzero(~same) + 1)) if len(new["list"]) else np.zeros(1, int)
        if len(cut) > 1:
            yield {c: v[: cut[-1]] for c, v in new.items()}, cut
        kept = {c: v[cut[-1] :] for c, v in new.items()}
    if kept and len(kept["list"]):
        yield kept, np.array([0, len(kept["list"])])


def _groups(batches, names):
    for g, cut in _whole(batches, names):
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield {c: v[lo:hi] for c, v in g.items()}


def _sides(g):
    """Places of the two blocks of a group, which are one for i = j."""
    return (np.flatnonzero(g["chunk"] == g[c][0]) for c in ("i", "j"))


def _upper(dot: np.ndarray, dim: int, e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """No cosine is above this: that of two sketches, what these leave out (e, f), and the rounding of ``dot``."""
    return dot + e + (1 + e) * f + dim * 1e-6


def _screen(threshold: float):
    """Members of a pair of blocks that may be linked with one of the other block, with the block pair.

    Groups of up to ``FEW`` members are worked out together, each member against the next ones.
    """

    def screen(batches):
        for g, cut in _whole(batches, (*KEY, "chunk", "cls", "sketch", "scale", "rest")):
            size = np.diff(cut)
            group, hit = np.repeat(np.arange(len(size)), size), np.zeros(cut[-1], bool)
            width = np.array([len(x) for x in g["sketch"]])
            for dim in np.unique(width):
                at = np.flatnonzero(width == dim)
                x = np.frombuffer(b"".join(g["sketch"][at]), np.int8).reshape(-1, dim) * g["scale"][at].astype(np.float32)[:, None]
                e, own, chunk, m = g["rest"][at], group[at], g["chunk"][at], size[group[at]]
                one = g["i"][at] == g["j"][at]
                for step in range(1, min(FEW, int(m.max()))):
                    u = np.flatnonzero((own[step:] == own[:-step]) & (m[step:] <= FEW))
                    u = u[one[u] | (chunk[u] != chunk[u + step])]
                    for lo in range(0, len(u), 1 << 16):
                        a = u[lo : lo + (1 << 16)]
                        b = a + step
                        near = _upper(np.einsum("ij,ij->i", x[a], x[b]), dim, e[a], e[b]) >= threshold
                        hit[at[a[near]]] = hit[at[b[near]]] = True
                for k in np.unique(own[m > FEW]):
                    lo, hi = np.searchsorted(own, (k, k + 1))
                    a, b = (lo + p for p in _sides({c: g[c][at[lo:hi]] for c in (*KEY, "chunk")}))
                    near = _upper(x[a] @ x[b].T, dim, e[a][:, None], e[b][None, :]) >= threshold
                    if one[lo]:
                        np.fill_diagonal(near, False)
                    hit[at[a[near.any(1)]]] = True
                    hit[at[b[near.any(0)]]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(g[c][hit]) for c in (*KEY, "chunk", "cls")], [*KEY, "chunk", "cls"])

    return screen


def _matcher(threshold: float):
    """Of each pair of blocks: for each vector its linked copies there, and links that span the linked parts."""

    def match(batches):
        for g in _groups(batches, (*KEY, "chunk", "cls", "best", "copies", "vec", "lists")):
            # the smallest id of a class, then the class, number the members
            by = np.lexsort((g["cls"], g["best"]))
            g = {c: v[by] for c, v in g.items()}
            x = np.frombuffer(b"".join(g["vec"]), float).reshape(len(g["cls"]), -1)
            a, b = _sides(g)
            if not len(a) or not len(b):
                continue
            hit = x[a] @ x[b].T >= threshold
            hit &= a[:, None] < b[None, :] if g["i"][0] == g["j"][0] else True
            p, q = np.nonzero(hit)
            if not len(p):
                continue
            u, v = a[p], b[q]
            # a pair that shares several lists counts in the first of them
            lists = np.stack(list(g["lists"]))
            ok = np.ones(len(u), bool)
            for lo in range(0, len(u), 1 << 16):
                s, t = lists[u[lo : lo + (1 << 16)]], lists[v[lo : lo + (1 << 16)]]
                both = (s[:, :, None] == t[:, None, :]).any(2)
                ok[lo : lo + (1 << 16)] = np.where(both, s, np.iinfo(np.int64).max).min(1) == g["list"][0]
            u, v = u[ok], v[ok]
            if not len(u):
                continue
            n = np.bincount(u, g["copies"][v], len(x)) + np.bincount(v, g["copies"][u], len(x))
            root = np.arange(len(x))
            while True:  # smallest member reachable inside the block
                low = root.copy()
                np.minimum.at(low, u, root[v])
                np.minimum.at(low, v, root[u])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (g["cls"][at], g["best"][at], n[at].astype(np.int64), g["cls"][root[at]], g["best"][root[at]])], ["cls", "best", "n", "root", "root_best"]
            )

    return match


def pivot_number(n: int) -> int:
    """Pivots for ``n`` vectors: the power of two from twice the root of n, within the bounds."""
    return min(MOST_PIVOTS, max(PIVOTS, 1 << max(0, (4 * n - 1).bit_length() + 1) // 2))


def choose_pivots(vectors: DataFrame, dim: int, n: int) -> np.ndarray:
    """Pivots for ``n`` vectors of one size, from a sample of a bounded number of them by hash.

    The first ``PIVOTS`` are each the vector farthest from those before, the others the next ones
    of the sample; none is nearer than ``APART`` to one chosen before, as copies in a dense group
    would see pivots inside it in any order.
    """
    pivots = pivot_number(n)
    sample = SAMPLE * (pivots + PIVOTS * 3)
    by = F.xxhash64("id", "v")
    share = min(1.0, 1.5 * sample / max(1, n))
    got = vectors.where(F.pmod(by, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy(by, "id").limit(sample).select("id", "v").toArrow()
    some = [x for _, x in _parse(got["v"], (dim,))]
    if not some:
        return np.zeros((1, dim))
    x = normalised(some[0])
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, len(x)) and near.min() <= APART:
        k = int(near.argmin())
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    found = x[chosen]
    for lo in range(0, len(x), ROWS):
        if len(found) >= pivots:
            break
        block = x[lo : lo + ROWS]
        block = block[(block @ found.T).max(1) <= APART]
        cos, apart = block @ block.T, []
        for k in range(len(block)):
            if not apart or cos[k, apart].max() <= APART:
                apart.append(k)
        found = np.concatenate((found, block[apart][: pivots - len(found)]))
    return found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    Rows link when their vectors are of one size and their cosine is at least ``threshold``.
    Null, empty and zero vectors and those with null or infinite components link with
    nothing: n_links 0, their own component.  Repeated rows link with
    each other and are counted; other columns are not read.
    """
    sc = Scratch(vectors.sparkSession, "embedding-dedup")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sizes = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().where("count > 1").collect()
    pivots = {r["d"]: choose_pivots(rows.where(F.size("v") == r["d"]), r["d"], r["count"]) for r in sorted(sizes)}
    listed = sc.keep(rows.mapInArrow(_normaliser(set(pivots)), "id long, vec binary"))
    # equal vectors are one class with a number of copies and a smallest id, and are indexed once
    listed = listed.withColumn("cls", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    classes = listed.where("vec is not null").groupBy("cls", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("best"))
    classes = sc.keep(classes.mapInArrow(_indexer(pivots), f"cls long, vec binary, copies long, best long, {MADE}"))
    spread = classes.select("cls", F.explode("lists").alias("list"))
    length = spread.groupBy("list").agg(F.count("*").alias("m")).where("m > 1").withColumn("c", F.ceil(F.col("m") / CHUNK).cast("int"))
    blocks = spread.join(length, "list").withColumn("chunk", F.pmod(F.xxhash64(F.col("cls"), F.lit(7)), F.col("c")).cast("int"))
    blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    blocks = blocks.select("list", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "cls")

    def together(blocks, *columns):
        got = blocks.join(classes.select("cls", *columns), "cls").repartition(*KEY).sortWithinPartitions(*KEY)
        return got.select(*KEY, "chunk", "cls", *columns)

    place = "list long, i int, j int, chunk int, cls long"
    maybe = sc.keep(together(blocks, "sketch", "scale", "rest").mapInArrow(_screen(threshold), place))
    found = together(maybe, "best", "copies", "vec", "lists").mapInArrow(_matcher(threshold), "cls long, best long, n long, root long, root_best long")
    found = sc.keep(found)
    # a class is named by its smallest id, so that a component brings its own
    a, b = (F.struct(F.col(x).alias("best"), F.col(y).alias("cls")) for x, y in (("best", "cls"), ("root_best", "root")))
    label = components(sc, found.select(a.alias("a"), b.alias("b"))).select("node.cls", F.col("comp.best").alias("component_id"))
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    told = classes.select("cls", "copies", "best").join(links, "cls", "left").join(label, "cls", "left")
    told = sc.keep(told.select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "best").alias("component_id")))
    # rows without a usable vector take no part in the join
    none = listed.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    told = listed.where("vec is not null").select("id", "cls").join(told, "cls").select("id", "n_links", "component_id").union(none)
    return told.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")
