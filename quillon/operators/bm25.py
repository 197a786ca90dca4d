"""Inverted index and Okapi BM25 as joins.

The index is four tables: postings (term, chunk, tf, with the chunk's length and language),
doc_stats (chunk, dl), term_idf (term, df, idf) and corpus_stats (one row).  A search deals postings of
query terms by chunk and sends the query terms after them, so that scores are added up without
a shuffle of what is added; statistics are always those of the whole index, language filters apply to the candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_lang, segments

#: query terms of at most this many rows go to the tasks that read postings; more of them are shuffled to their postings
BROADCAST_TERMS = 1 << 20
#: rows of postings and query terms that meet in one task, about; it holds the sums of as many pairs at most
TASK_HITS = 1 << 22
# fixed values: the constants of Okapi BM25
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Bm25Index:
    postings: DataFrame
    doc_stats: DataFrame
    term_idf: DataFrame
    corpus_stats: DataFrame
    #: (text, lang) -> terms, which queries are cut with too, and its name for Japanese
    cut: Callable[[Column, Column], Column] = segments
    segmenter: str = "char-bigram"

    @property
    def name(self) -> str:
        return f"bm25:{self.segmenter}"

    def count(self) -> int:
        return self.doc_stats.count()


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: runs of the sorted array, counted in the row."""
    ordered = F.sort_array(terms)

    def runs(t):
        places = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
        starts = F.filter(places, lambda i: (F.size(t) > 0) & ((i == 1) | (F.get(t, i - 1) != F.get(t, i - 2))))
        count = lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t) + 1) - i).cast("long").alias("tf")))
        return F.transform(F.array(starts), count)[0]

    return F.transform(F.array(ordered), runs)[0]


def counted(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", lang_col: str = "lang", cut: Callable[[Column, Column], Column] = segments) -> DataFrame:
    """(chunk_id, lang, dl, counts): the terms of each text with their numbers; nothing is shuffled."""
    terms = chunks.select(F.col(id_col).alias("chunk_id"), F.col(lang_col).alias("lang"), cut(F.col(text_col), F.col(lang_col)).alias("terms"))
    return terms.select("chunk_id", "lang", F.size("terms").cast("long").alias("dl"), term_counts(F.col("terms")).alias("counts"))


def index_of(rows: DataFrame, cut: Callable[[Column, Column], Column] = segments, segmenter: str = "char-bigram") -> Bm25Index:
    """The index of counted texts."""
    doc_stats = rows.select("chunk_id", "lang", "dl")
    postings = rows.select("chunk_id", "lang", "dl", F.explode("counts").alias("c")).select("chunk_id", "c.term", "c.tf", "dl", "lang")
    stats = doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n_docs")))
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # negative values give way to a share of the mean over the vocabulary, which counts them
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.crossJoin(F.broadcast(mean)).select(
        "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf")
    )
    return Bm25Index(postings, doc_stats, idf, stats, cut, segmenter)


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", lang_col: str = "lang", cut: Callable[[Column, Column], Column] = segments, segmenter: str = "char-bigram") -> Bm25Index:
    return index_of(counted(chunks, id_col, text_col, lang_col, cut), cut, segmenter)


def query_terms(queries: DataFrame, cut: Callable[[Column, Column], Column] = segments) -> DataFrame:
    """(query_id, term, qtf): terms with their multiplicity; queries are cut by their script."""
    terms = cut(F.col("query"), query_lang(F.col("query")))
    return queries.select("query_id", F.explode(terms).alias("term")).where("trim(replace(term, '\"', '')) <> ''").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bounded(rows: DataFrame) -> DataFrame:
    """Query terms, or rows of queries, marked as what is broadcast, if they are few."""
    return _marked(rows, _few(rows))


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def weighed(terms: DataFrame, term_idf: DataFrame) -> DataFrame:
    """Query terms with their idf, marked as ``bounded`` marks them."""
    few = _few(terms)
    return _marked(_marked(terms, few).join(term_idf.select("term", "idf"), "term"), few)


def _marked(terms: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(terms) if few else terms.hint("shuffle_hash")


def matched(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """The rows of ``terms`` (query_id, term, ...) with their idf and each posting that holds the term.

    The smaller side goes to all tasks and the other is dealt by its chunks or queries, so that
    whatever is added up for a query and chunk is added up where it is made: what is shuffled are
    postings or terms, never the rows of both, of which there are many more.
    """
    asked = terms.groupBy("term").agg(F.count("*").alias("n"))
    size = index.term_idf.join(asked, "term", "left").agg(F.sum("df").alias("postings"), F.sum("n").alias("terms"), F.sum(F.col("n") * F.col("df")).alias("hits")).first()
    n_postings, n_terms = size.postings or 0, size.terms or 0
    tasks = max(terms.sparkSession.sparkContext.defaultParallelism, -(-(size.hits or 0) // TASK_HITS))
    few = n_terms <= BROADCAST_TERMS
    known = _marked(terms, few).join(index.term_idf.select("term", "idf"), "term")
    if few and n_terms <= n_postings:
        held = index.postings.join(F.broadcast(asked.select("term")), "term", "left_semi").repartition(tasks, "chunk_id")
        return held.join(F.broadcast(known), "term")
    if n_postings <= BROADCAST_TERMS:
        return known.repartition(tasks, "query_id").join(F.broadcast(index.postings), "term")
    return known.hint("shuffle_hash").join(index.postings, "term")


def candidates(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id) that share a term."""
    return matched(index, terms).select("query_id", "chunk_id").distinct()


def coverage(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the number of the query's different terms that a chunk holds."""
    return matched(index, terms).groupBy("query_id", "chunk_id").agg(F.count("*").cast("double").alias("score"))


def scores(index: Bm25Index, terms: DataFrame, lang_of: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all candidates; ``lang_of`` (query_id, lang) filters them."""
    if lang_of is not None:
        terms = terms.join(lang_of.select("query_id", F.col("lang").alias("wanted_lang")), "query_id", "left")
    hit = matched(index, terms).crossJoin(F.broadcast(index.corpus_stats.select("avgdl")))
    if lang_of is not None:
        hit = hit.where("wanted_lang is null or lang = wanted_lang")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k best of each query, ties by id; pruned before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def search(index: Bm25Index, queries: DataFrame, k: int = 5, lang_of: DataFrame | None = None, fill_zero_scores: bool = False) -> DataFrame:
    """The k best chunks of each query (query_id, query).

    With ``fill_zero_scores`` chunks without a query term fill up the k places, by id.
    """
    terms = query_terms(queries, index.cut)
    scored = scores(index, terms, lang_of)
    if fill_zero_scores:
        # only queries with fewer than k hits need filling: of any 2 k chunks, k are no hits of theirs
        order = Window.partitionBy("lang").orderBy("chunk_id")
        fill = index.doc_stats.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 2 * k).select("chunk_id", "lang")
        rest = queries.select("query_id").crossJoin(F.broadcast(fill))
        if lang_of is not None:
            rest = rest.join(lang_of.select("query_id", F.col("lang").alias("wanted_lang")), "query_id", "left").where("wanted_lang is null or lang = wanted_lang")
        # of the postings only those of such chunks tell which of them are hits
        some = index.postings.join(F.broadcast(fill.select("chunk_id")), "chunk_id", "left_semi")
        held = some.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").select("term", "chunk_id")
        hits = terms.join(held, "term").select("query_id", "chunk_id").distinct()
        rest = rest.join(hits, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
        scored = top_k(scored, k).drop("rank").unionByName(rest)
    return top_k(scored, k)
