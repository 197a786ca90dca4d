"""Command line: build a corpus and its indexes, ask, evaluate, compare, gate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine, EngineConfig
from .operators import chunking, counters, evaluation, providers
from .sources import reports, tables


def build_corpus(spark, a):
    docs = tables.read_markdown(spark, a.root, commit_sha=a.sha, include_reference=a.include_reference)
    counter = counters.FileCounter(a.tokenizer) if a.tokenizer else counters.HEURISTIC
    chunks = chunking.chunk_documents(docs, a.strategy, target=a.target, overlap=a.overlap, least=a.least, counter=counter)
    tables.write_lines(chunks, a.out)
    settings = {"corpus_sha": a.sha, "strategy": a.strategy, "target_tokens": a.target, "overlap_tokens": a.overlap, "min_tokens": a.least, "tokenizer": counter.name, "output": a.out}
    made = chunking.manifest(docs, tables.read_chunks(spark, a.out), **settings)
    made.coalesce(1).write.mode("overwrite").json(a.out.rstrip("/") + ".manifest")
    made.show(truncate=False)


def build_index(spark, a):
    tables.upsert_vectors(tables.read_chunks(spark, a.chunks), providers.get_embedder(a.embedder, a.allow_fallback), a.out)


def build_sparse_index(spark, a):
    print(tables.build_or_load(spark, a.chunks, a.out).count())


def _engine(spark, a, offline: bool = False, **more) -> Engine:
    """An engine by the environment and the arguments; ``offline``: with components that need no model."""
    config = EngineConfig.from_env()
    if offline:
        config.llm_provider = config.embedder_model = None
    for k, v in {"chunks_path": a.chunks, "retriever": getattr(a, "retriever", None), "verifier_method": getattr(a, "verifier", None), **more}.items():
        if v is not None:
            setattr(config, k, v)
    return Engine.build(spark, config)


def ask(spark, a):
    questions = spark.createDataFrame([(str(i), q) for i, q in enumerate(a.question)], "query_id string, question string")
    _engine(spark, a).ask(questions, a.top_k).select("question", "answer_text", "final_text", "refused", "refusal_reason").show(truncate=False)


def run_eval(spark, a):
    got = _engine(spark, a).evaluate(tables.read_gold(spark, a.gold), a.top_k, a.lang_filter)
    got.show(truncate=False)
    if a.out:
        reports.append(got, a.out, a.name)
        reports.deltas(reports.history(spark, a.out).where(F.col("name") == a.name)).show(truncate=False)


def _arm(name: str, a, config: EngineConfig) -> dict:
    """Settings of an arm: a retriever, with '+rerank' reranked, and '@fixed' or '@second' over the other chunks or embedder."""
    base, _, variant = name.partition("@")
    retriever, _, more = base.partition("+")
    other = {"": {}, "fixed": {"chunks_path": a.fixed_chunks}, "second": {"embedder_model": a.second_embedder}}.get(variant)
    if more not in ("", "rerank") or other is None:
        raise ValueError(f"unknown arm {name!r}; expected a retriever, '+rerank' behind it, then '@fixed' or '@second'")
    if None in other.values():
        raise ValueError(f"arm {name!r} needs --fixed-chunks or --second-embedder")
    # another corpus or embedder has an index of its own
    places = {k: f"{getattr(config, k)}-{variant}" for k in ("index_dir", "sparse_index_path")} if variant else {}
    return {"retriever": retriever, "rerank": more == "rerank"} | other | places


def ablate(spark, a):
    gold, arms = tables.read_gold(spark, a.gold), {}
    for name in a.arms:
        engine = _engine(spark, a, **_arm(name, a, EngineConfig.from_env()))
        arms[name] = engine.evaluate(gold, a.top_k)
        arms[f"{name}_match_query"] = engine.evaluate(gold, a.top_k, "match_query")
    evaluation.ablation(arms).show(100, truncate=False)


def compare_sparse(spark, a):
    gold = tables.read_gold(spark, a.gold)
    asked = gold.select(F.col("id").alias("query_id"), "query")
    items = gold.select(F.col("id").alias("query_id"), "lang", F.col("relevant_parallel_ids").alias("relevant"))
    pages = tables.read_chunks(spark, a.chunks).select("chunk_id", F.col("parallel_id").alias("page_id"))
    found = [tables.kept(evaluation.page_ranking(_engine(spark, a, True, retriever="sparse", sparse_backend=b).retriever.search(asked, a.top_k).join(pages, "chunk_id"))) for b in ("memory", "fts5")]
    first, second = (evaluation.report(evaluation.item_metrics(items, r)) for r in found)
    evaluation.parity(*found).crossJoin(F.broadcast(evaluation.deltas(first, second))).show()


def compare_verifiers(spark, a):
    items = tables.read_faithfulness(spark, a.items)
    for method in a.methods:
        print(method)
        evaluation.label_metrics(_engine(spark, a, retriever="sparse", verifier_method=method).evaluate_verifier(items)).show()


def eval_refusal(spark, a):
    gold = tables.read_gold(spark, a.gold)
    got = _engine(spark, a).ask(gold.select(F.col("id").alias("query_id"), F.col("query").alias("question")), a.top_k, write_trace=False)
    evaluation.refusal_rates(got.join(gold.select(F.col("id").alias("trace_id"), "answerable"), "trace_id")).show()


def eval_gate(spark, a):
    engine = _engine(spark, a, True, retriever="sparse", verifier_method="lexical")
    recall = engine.evaluate(tables.read_gold(spark, a.gold)).where("lang is null").select(F.lit("bm25_recall_at_5").alias("metric"), F.col("recall_at_5").alias("value"))
    accuracy = evaluation.label_metrics(engine.evaluate_verifier(tables.read_faithfulness(spark, a.items))).limit(1)
    got = evaluation.gate(recall.union(accuracy.select(F.lit("lexical_faithfulness_accuracy"), "accuracy")))
    got.show(truncate=False)
    return int(not got.agg(F.bool_and("ok")).first()[0])


def validate_gold(spark, a):
    bad = evaluation.gold_problems(tables.read_lines(spark, a.gold, tables.GOLD), tables.read_chunks(spark, a.chunks).select("parallel_id"))
    bad.show(1000, truncate=False)
    return int(not bad.isEmpty())


def health(spark, a):
    print(_engine(spark, a).health())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *args, **options):
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        for x in args:
            c.add_argument(f"--{x}", required=True)
        for name, default in options.items():
            kind = {"action": "store_true"} if default is False else {"nargs": "+", "default": default} if isinstance(default, list) else {"type": type(default) if default is not None else str, "default": default}
            c.add_argument(f"--{name.replace('_', '-')}", **kind)

    command(build_corpus, "root", "out", sha="", strategy="structural", target=chunking.TARGET, overlap=chunking.OVERLAP, least=chunking.LEAST, include_reference=False, tokenizer=None)
    command(build_index, "chunks", "out", embedder=None, allow_fallback=False)
    command(build_sparse_index, "chunks", "out")
    command(ask, "chunks", question=[], top_k=5, retriever=None, verifier=None)
    command(run_eval, "chunks", "gold", top_k=10, retriever=None, lang_filter=None, out=None, name="eval")
    command(ablate, "chunks", "gold", top_k=10, arms=["sparse"], fixed_chunks=None, second_embedder=None)
    command(compare_sparse, "chunks", "gold", top_k=10)
    command(compare_verifiers, "chunks", "items", methods=["lexical"])
    command(eval_refusal, "chunks", "gold", top_k=5, retriever=None, verifier=None)
    command(eval_gate, "chunks", "gold", "items")
    command(validate_gold, "chunks", "gold")
    command(health, "chunks", retriever=None)
    a = p.parse_args(argv)
    return a.run(SparkSession.builder.appName("quillon").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
