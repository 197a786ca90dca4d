"""Dense search, rank fusion and two-phase reranking over ranked frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the rank constant of fusion, what each list is asked for, and what a reranker sees
RRF_K, FUSE_FETCH, RERANK_FETCH = 60, 50, 20
#: queries of one matrix product
QUERY_BLOCK = 1024
#: queries of more bytes are dealt into blocks instead of going to every task
QUERY_BYTES = 32 << 20
#: queries and vectors in a block, about
GRID_QUERIES, GRID_VECTORS = 8192, 16384


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; 0 if either has no length, an error if the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    safe = F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), safe).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def require_dim(vectors: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """``vectors``, failing on the first vector of another size when it is read."""
    ok = F.size(vec_col) == dim
    return vectors.withColumn(vec_col, F.when(ok, F.col(vec_col)).otherwise(F.raise_error(F.lit(f"a vector's size is not {dim}")).cast(vectors.schema[vec_col].dataType)))


def _matrix(vectors: pa.Array, dim: int | None) -> np.ndarray:
    """Vectors of one Arrow column as rows of length one; a zero vector stays zero, a null component makes it NaN."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != (dim or sizes[0])).any():
        raise ValueError("vectors of different lengths")
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)
    norm = np.linalg.norm(x, axis=1)
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] != 0)


class Nearest:
    """The k best vectors of each of a block's queries among those shown so far.

    Scores are rounded to nine places for the order; ties go to the smaller id, so exactly k
    are held whatever the number of equal vectors.  An id counts once, with its best score.
    """

    def __init__(self, queries: np.ndarray, wanted: list[str | None], k: int):
        self.queries, self.wanted, self.k = queries, wanted, k
        self.held = pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, object), "r": np.zeros(0), "s": np.zeros(0)})

    def show(self, ids: np.ndarray, x: np.ndarray, kinds: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x, kinds = ids[order], x[order], kinds[order]
        for lo in range(0, len(self.queries), QUERY_BLOCK):
            rows = slice(lo, lo + QUERY_BLOCK)
            s = self.queries[rows] @ x.T
            s[~np.isfinite(s)] = -np.inf
            for i, want in enumerate(self.wanted[rows]):
                if want is not None:
                    s[i, kinds != want] = -np.inf
            same = np.flatnonzero(ids[1:] == ids[:-1])
            if len(same):
                first = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))
                s, names = np.maximum.reduceat(s, first, axis=1), ids[first]
            else:
                names = ids
            r = np.round(s, 9)
            if r.shape[1] > self.k:
                edge = -np.partition(-r, self.k - 1, axis=1)[:, self.k - 1 : self.k]
                over, tied = r > edge, r == edge
                pick = over | tied & (np.cumsum(tied, axis=1) <= self.k - over.sum(1, keepdims=True))
            else:
                pick = np.ones(r.shape, bool)
            q, j = np.nonzero(pick & np.isfinite(r))
            self._hold(pd.DataFrame({"q": q + lo, "id": names[j], "r": r[q, j], "s": s[q, j]}))

    def _hold(self, more: pd.DataFrame) -> None:
        both = pd.concat((self.held, more)) if len(self.held) else more
        both = both.sort_values(["q", "r", "id"], ascending=[True, False, True], kind="stable").drop_duplicates(["q", "id"])
        self.held = both.groupby("q", sort=False).head(self.k)

    def hits(self, query_ids: list[str]) -> pa.RecordBatch:
        names = np.array(query_ids, object)[self.held["q"].to_numpy()]
        columns = [pa.array(names, pa.string()), pa.array(self.held["id"].to_numpy(), pa.string()), pa.array(self.held["r"].to_numpy()), pa.array(self.held["s"].to_numpy())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "r", "score"])


_HITS = "query_id string, chunk_id string, r double, score double"


def _columns(table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    ids, kinds = (np.array(table.column(c).to_pylist(), object) for c in ("id", "kind"))
    v = table.column("v")
    return ids, v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v, kinds


def _against_all(block: pa.Table, k: int):
    """Every task holds the queries and the k best of all its vectors."""

    def run(batches):
        ids, vectors, wanted = _columns(block)
        q = _matrix(vectors, None)
        best = Nearest(q, wanted.tolist(), k)
        for batch in batches:
            if batch.num_rows:
                names, x, kinds = _columns(batch)
                best.show(names, _matrix(x, q.shape[1]), kinds)
        yield best.hits(ids.tolist())

    return run


def _cell(k: int):
    """One block of queries against one block of vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors, wanted = _columns(left)
        q = _matrix(vectors, None)
        best = Nearest(q, wanted.tolist(), k)
        if len(ids) and right.num_rows:
            names, x, kinds = _columns(right)
            best.show(names, _matrix(x, q.shape[1]), kinds)
        return pa.Table.from_batches([best.hits(ids.tolist())])

    return run


def _blocked(slim: DataFrame, named: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Both sides dealt into blocks of bounded size; every pair of blocks is one group of a cogroup."""
    q_blocks, v_blocks = -(-n_queries // GRID_QUERIES), max(1, -(-slim.count() // GRID_VECTORS))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = named.distinct().withColumn("qb", F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks)).cast("int")).withColumn("vb", other(v_blocks))
    # rows that repeat one id and vector are spread by where they are read
    place = F.xxhash64("id", "v", F.spark_partition_id())
    vectors = slim.withColumn("vb", F.pmod(place, F.lit(v_blocks)).cast("int")).withColumn("qb", other(q_blocks))
    return queries.groupBy("qb", "vb").cogroup(vectors.groupBy("qb", "vb")).applyInArrow(_cell(k), _HITS)


def dense_search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", vec_col: str = "embedding", filter_col: str | None = None, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k nearest vectors of each query (query_id, embedding[, wanted]).

    Queries of at most ``query_bytes`` go to every task, which keeps the k best of all vectors it
    reads; more of them are dealt into blocks, as the vectors are, and each pair of blocks is a
    group of its own.  One window merges what the tasks or groups kept.  Null vectors, and those
    with a null or non-finite component, are found by none and find none; a zero vector has cosine
    0 with all; vectors of different lengths are an error.  Rows of one query id with different
    vectors are one query: a chunk has its best score over them; so has a repeated chunk id.
    """
    kind = F.col(filter_col).cast("string") if filter_col else F.lit(None).cast("string")
    wanted = F.col("wanted").cast("string") if "wanted" in queries.columns else F.lit(None).cast("string")
    slim = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), kind.alias("kind")).where("v is not null and id is not null")
    named = queries.select(F.col("query_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"), wanted.alias("kind")).where("v is not null and id is not null")
    size = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("v") + F.length("id") + 64), F.lit(0)).alias("bytes")).first()
    if size.n and size.bytes <= query_bytes:
        found = slim.mapInArrow(_against_all(named.toArrow(), k), _HITS)
    else:
        found = _blocked(slim, named, size.n, k) if size.n else vectors.sparkSession.createDataFrame([], _HITS)
    once = found.groupBy("query_id", "chunk_id").agg(F.max("r").alias("r"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("r").desc(), "chunk_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def fuse(first: DataFrame, second: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: only ranks count, scores may be of any scale."""
    both = first.select("query_id", "chunk_id", "rank").unionAll(second.select("query_id", "chunk_id", "rank"))
    return ranked(both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score")), k)


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, score: Column, k: int = 5, fetch: int = RERANK_FETCH) -> DataFrame:
    """The first max(k, fetch) hits of each query ordered anew by ``score`` over columns query and text."""
    few = hits.where(F.col("rank") <= max(k, fetch)).select("query_id", "chunk_id")
    pairs = few.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return ranked(pairs.select("query_id", "chunk_id", score.alias("score")), k)


def with_payload(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns, fetched after the ranking is done."""
    return hits.join(chunks, "chunk_id")
