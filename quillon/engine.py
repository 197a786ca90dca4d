"""The engine: a configuration, its components, and batches of questions answered in one plan."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bm25, correction, dense, evaluation, prompts, providers
from .schemas import TRACE
from .sources import tables, traces

_NONE = {"", "none", "fake", "echo"}


@dataclass
class EngineConfig:
    index_dir: str = "data/vectors"
    embedder_model: str | None = providers.EMBEDDER
    llm_provider: str | None = "groq"
    verifier_method: str = "lexical"
    decomposer_mode: str = "sentence"
    retriever: str = "dense"
    chunks_path: str = "data/chunks/structural_t512_o64.jsonl"
    sparse_backend: str = "memory"
    sparse_index_path: str = "data/index/bm25"
    segmenter: str = "char-bigram"
    rerank: bool = False
    reranker_model: str | None = providers.RERANKER
    top_k: int = 5
    refusal_threshold: float = correction.REFUSAL_THRESHOLD
    allow_fallback: bool = False
    trace_path: str = "data/traces/quillon.jsonl"

    #: names of the variables, after the prefix
    _VARIABLES = {"embedder_model": "EMBEDDER", "llm_provider": "LLM", "verifier_method": "VERIFIER", "decomposer_mode": "DECOMPOSER", "chunks_path": "CHUNKS", "reranker_model": "RERANKER"}

    @property
    def needs_embedder(self) -> bool:
        return self.retriever in ("dense", "hybrid") or self.verifier_method == "embedding"

    @classmethod
    def from_env(cls, env=os.environ, prefix: str = "QUILLON_") -> EngineConfig:
        """Fields from the environment; 'none', 'fake', 'echo' or nothing name no model."""
        got = {}
        for f in fields(cls):
            raw = env.get(prefix + cls._VARIABLES.get(f.name, f.name.upper()))
            if raw is None:
                continue
            if f.name in ("embedder_model", "llm_provider", "reranker_model"):
                got[f.name] = None if raw in _NONE else raw
            elif f.name in ("allow_fallback", "rerank"):
                got[f.name] = raw.lower() in ("1", "true", "yes")
            else:
                got[f.name] = type(f.default)(raw)
        return cls(**got)


class SparseRetriever:
    """BM25 over stored tables or over chunks held in the session."""

    def __init__(self, index: bm25.Bm25Index, backend: str = "memory"):
        self.index, self.backend = index, backend
        self.name = f"{'fts5' if backend == 'fts5' else 'bm25'}:{index.segmenter}"

    def count(self) -> int:
        return self.index.count()

    def search(self, queries: DataFrame, top_k: int = 5, lang_of: DataFrame | None = None) -> DataFrame:
        return bm25.search(self.index, queries, top_k, lang_of, fill_zero_scores=self.backend == "memory")


class DenseRetriever:
    def __init__(self, vectors: DataFrame, embedder):
        self.vectors, self.embedder, self.name = dense.require_dim(vectors, "embedding", embedder.dim), embedder, f"dense:{embedder.name}"

    def count(self) -> int:
        return self.vectors.count()

    def search(self, queries: DataFrame, top_k: int = 5, lang_of: DataFrame | None = None) -> DataFrame:
        q = queries.select("query_id", self.embedder.embed_query(F.col("query")).alias("embedding"))
        if lang_of is not None:
            q = q.join(lang_of.select("query_id", F.col("lang").alias("wanted")), "query_id", "left")
        return dense.dense_search(self.vectors, q, top_k, filter_col="lang")


class HybridRetriever:
    def __init__(self, first, second):
        self.first, self.second, self.name = first, second, f"rrf({first.name},{second.name})"

    def count(self) -> int:
        return -1

    def search(self, queries: DataFrame, top_k: int = 5, lang_of: DataFrame | None = None) -> DataFrame:
        return dense.fuse(self.first.search(queries, dense.FUSE_FETCH, lang_of), self.second.search(queries, dense.FUSE_FETCH, lang_of), top_k)


class RerankingRetriever:
    def __init__(self, base, reranker, chunks: DataFrame, fetch: int = dense.RERANK_FETCH):
        self.base, self.reranker, self.chunks, self.fetch, self.name = base, reranker, chunks, fetch, f"{base.name}+{reranker.name}"

    def count(self) -> int:
        return self.base.count()

    def search(self, queries: DataFrame, top_k: int = 5, lang_of: DataFrame | None = None) -> DataFrame:
        hits = self.base.search(queries, max(top_k, self.fetch), lang_of)
        return dense.rerank(hits, queries, self.chunks, self.reranker.score(F.col("query"), F.col("text")), top_k, self.fetch)


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig, chunks: DataFrame, retriever, llm, verify, decompose, embedder_name: str = "none"):
        self.spark, self.config, self.chunks, self.retriever = spark, config, chunks, retriever
        self.llm, self.verify, self.decompose, self.embedder_name = llm, verify, decompose, embedder_name

    @classmethod
    def build(cls, spark: SparkSession, config: EngineConfig) -> Engine:
        """All components of a configuration; unknown names and a missing chunk file fail here."""
        fs, path = tables._fs(spark, config.chunks_path)
        if not fs.exists(path):
            raise FileNotFoundError(f"no chunk file at {config.chunks_path}")
        if config.retriever not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown retriever {config.retriever!r}; expected 'dense', 'sparse' or 'hybrid'")
        if config.sparse_backend not in ("memory", "fts5"):
            raise ValueError(f"unknown sparse backend {config.sparse_backend!r}; expected 'memory' or 'fts5'")
        if config.segmenter not in ("char-bigram", "auto"):
            raise ValueError(f"unknown segmenter {config.segmenter!r}; expected 'char-bigram' or 'auto'")
        chunks = tables.read_chunks(spark, config.chunks_path)
        embedder = providers.get_embedder(config.embedder_model, config.allow_fallback) if config.needs_embedder else None
        llm = providers.get_llm(config.llm_provider, config.allow_fallback)
        parts = []
        if config.retriever in ("dense", "hybrid"):
            have = tables.collection_state(spark, config.index_dir)
            vectors = tables.read_vectors(spark, config.index_dir) if have and have["embedder"] == embedder.name else tables.upsert_vectors(chunks, embedder, config.index_dir)
            parts.append(DenseRetriever(vectors, embedder))
        if config.retriever in ("sparse", "hybrid"):
            stored = config.sparse_backend == "fts5"
            cutting = providers.get_cut() if config.segmenter == "auto" else {}
            index = tables.build_or_load(spark, config.chunks_path, config.sparse_index_path, **cutting) if stored else bm25.build_index(chunks, **cutting)
            parts.append(SparseRetriever(index, config.sparse_backend))
        retriever = parts[0] if len(parts) == 1 else HybridRetriever(*parts)
        if config.rerank:
            retriever = RerankingRetriever(retriever, providers.get_reranker(config.reranker_model, config.allow_fallback), chunks)
        verify = providers.get_verifier(config.verifier_method, llm=llm, embedder=embedder, allow_fallback=config.allow_fallback)
        return cls(spark, config, chunks, retriever, llm, verify, providers.get_decomposer(config.decomposer_mode, llm), embedder.name if embedder else "none")

    def sources(self, queries: DataFrame, top_k: int, lang_of: DataFrame | None = None) -> DataFrame:
        hits = tables.kept(self.retriever.search(queries, top_k, lang_of))
        return dense.with_payload(hits, self.chunks.select("chunk_id", "parallel_id", "lang", "title", "section_path", "text"))

    def ask(self, questions: DataFrame, top_k: int | None = None, write_trace: bool = True) -> DataFrame:
        """Traces of questions (query_id, question[, lang]): retrieved, answered, verified, corrected.

        The answers are written before they are verified: a generator may answer otherwise
        when it is asked again.
        """
        began = time.perf_counter()
        k = top_k or self.config.top_k
        asked = questions.select(F.col("query_id").cast("string").alias("query_id"), F.col("question").alias("query"))
        lang_of = questions.select(F.col("query_id").cast("string").alias("query_id"), "lang") if "lang" in questions.columns else None
        sources = tables.kept(self.sources(asked, k, lang_of))
        replies = prompts.build_prompts(asked.withColumnRenamed("query", "question"), sources)
        folder = f"{tables.scratch_dir(self.spark)}/ask-{uuid.uuid4().hex}"
        replies.select(F.col("query_id").alias("answer_id"), "question", self.llm.generate(F.col("prompt")).alias("text")).write.parquet(f"{folder}/answers")
        answers = self.spark.read.parquet(f"{folder}/answers")
        first = time.perf_counter()
        claims = self.decompose(answers)
        evidence = sources.select(F.col("query_id").alias("answer_id"), (F.col("rank") - 1).alias("evidence_index"), F.col("text").alias("evidence"))
        self.verify(claims, evidence).write.parquet(f"{folder}/verdicts")
        verdicts = self.spark.read.parquet(f"{folder}/verdicts")
        second = time.perf_counter()
        again = correction.retry(verdicts, lambda q: self.sources(q, correction.RETRY_TOP_K).select("query_id", "rank", "text"), self.verify)
        decisions = tables.kept(correction.decide(verdicts, again))
        fixed = correction.corrected(answers, decisions, self.config.refusal_threshold)
        told = decisions.groupBy("answer_id").agg(
            F.array_sort(F.collect_list(F.struct("claim_index", F.col("claim").alias("text"), F.col("final_label").alias("label"), "action", F.col("final_method").alias("method")))).alias("claims")
        )
        seen = sources.groupBy(F.col("query_id").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "parallel_id", "title", "lang", "score"))).alias("retrieved"))
        got = answers.join(fixed, "answer_id").join(told, "answer_id", "left").join(seen, "answer_id", "left")
        if lang_of is not None:
            got = got.join(lang_of.select(F.col("query_id").alias("answer_id"), F.col("lang").alias("lang_filter")), "answer_id", "left")
        else:
            got = got.withColumn("lang_filter", F.lit(None).cast("string"))
        none = lambda n: F.array().cast(TRACE[n].dataType)
        out = got.select(
            F.col("answer_id").alias("trace_id"), F.lit(time.time()).alias("timestamp"), "question", "lang_filter",
            F.coalesce(F.transform("retrieved", lambda x: F.struct(*[x[n].alias(n) for n in ("chunk_id", "parallel_id", "title", "lang", "score")])), none("retrieved")).alias("retrieved"),
            F.col("text").alias("answer_text"), F.lit(self.llm.name).alias("llm_name"), F.lit(self.embedder_name).alias("embedder_name"), F.lit(self.config.verifier_method).alias("verifier_name"),
            F.coalesce(F.transform("claims", lambda x: F.struct(*[x[n].alias(n) for n in ("text", "label", "action", "method")])), none("claims")).alias("claims"),
            "final_text", "refused", "refusal_reason",
        )
        out.write.parquet(f"{folder}/out")
        third = time.perf_counter()
        ms = {"retrieval_and_generation": first - began, "verification": second - first, "correction": third - second, "total": third - began}
        latency = F.create_map(*[x for n, s in ms.items() for x in (F.lit(n), F.lit(round(s * 1000, 2)))])
        done = self.spark.read.parquet(f"{folder}/out").withColumn("latency_ms", latency)
        if write_trace:
            traces.append(done, self.config.trace_path)
        return done

    def evaluate(self, gold: DataFrame, top_k: int = 10, lang_filter: str | None = None) -> DataFrame:
        """The report of a gold table; ``lang_filter``: none, a language, or 'match_query' for each item's own."""
        queries = gold.select(F.col("id").alias("query_id"), "query")
        lang_of = None
        if lang_filter:
            lang = F.col("lang") if lang_filter == "match_query" else F.lit(lang_filter)
            lang_of = gold.select(F.col("id").alias("query_id"), lang.alias("lang"))
        hits = self.retriever.search(queries, top_k, lang_of).join(self.chunks.select("chunk_id", F.col("parallel_id").alias("page_id")), "chunk_id")
        items = gold.select(F.col("id").alias("query_id"), "lang", F.col("relevant_parallel_ids").alias("relevant"))
        return evaluation.report(evaluation.item_metrics(items, evaluation.page_ranking(hits)))

    def evaluate_verifier(self, items: DataFrame) -> DataFrame:
        """The confusion of faithfulness items (id, evidence, claim, true_label) under the engine's verifier."""
        claims = items.select(F.col("id").alias("answer_id"), F.lit(0).alias("claim_index"), "claim")
        evidence = items.select(F.col("id").alias("answer_id"), F.posexplode("evidence").alias("evidence_index", "evidence"))
        verdicts = self.verify(claims, evidence).select(F.col("answer_id").alias("id"), F.col("label").alias("predicted_label"))
        return evaluation.confusion(items.join(verdicts, "id").select("true_label", "predicted_label"))

    def health(self) -> dict:
        return {"status": "ok", "index_size": self.retriever.count(), "retriever": self.retriever.name, "llm": self.llm.name, "embedder": self.embedder_name, "verifier": self.config.verifier_method}


