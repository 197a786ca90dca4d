"""The engine end to end, stored tables, traces and the stream."""

import json
import os
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon import __main__ as cli
from quillon.engine import Engine, EngineConfig, HybridRetriever, RerankingRetriever
from quillon.operators import bm25, chunking, providers
from quillon.sources import reports, tables, traces
from quillon.streaming import monitor

PAGES = {
    "en/docs/pods.md": "---\ntitle: Pods\n---\n# Pods\nA pod runs one or more containers. Pods are scheduled to nodes by the scheduler.",
    "ja/docs/pods.md": "---\ntitle: ポッド\n---\n# ポッド\nポッドは一つ以上のコンテナを実行します。ポッドはノードに割り当てられます。",
    "en/docs/services.md": "# Services\nA service routes network traffic to a set of pods behind one address.",
    "en/docs/my-topic.md": "Volumes hold the data of containers over their restarts, whatever the node does.",
    "en/docs/reference/x.md": "generated",
    "en/docs/_index.md": "index",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for rel, body in PAGES.items():
        p = root / "content" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")
    docs = tables.read_markdown(spark, str(root), commit_sha="sha")
    chunks = f"{root}/chunks"
    tables.write_lines(chunking.chunk_documents(docs), chunks)
    return str(root), docs, chunks


def test_markdown_tree(corpus):
    got = {(r.lang, r.parallel_id): r for r in corpus[1].collect()}
    assert set(got) == {("en", "docs/pods.md"), ("ja", "docs/pods.md"), ("en", "docs/services.md"), ("en", "docs/my-topic.md")}
    assert got["en", "docs/my-topic.md"].title == "my topic" and got["ja", "docs/pods.md"].title == "ポッド"
    assert got["en", "docs/pods.md"].url.endswith("/en/docs/pods/")


def config(root, chunks, **more):
    base = dict(chunks_path=chunks, retriever="sparse", llm_provider=None, embedder_model=None, trace_path=f"{root}/traces", index_dir=f"{root}/vectors", sparse_index_path=f"{root}/bm25")
    return EngineConfig(**base | more)


def test_ask(spark, corpus):
    root, _, chunks = corpus
    engine = Engine.build(spark, config(root, chunks))
    q = spark.createDataFrame([("1", "What routes traffic to pods?", "en"), ("2", "ポッドはノードに", "ja")], "query_id string, question string, lang string")
    got = {r.trace_id: r for r in engine.ask(q).collect()}
    assert got["1"].retrieved[0].parallel_id == "docs/services.md" and got["2"].retrieved[0].lang == "ja"
    assert got["1"].refused and got["1"].llm_name == "echo" and set(got["1"].latency_ms) == {"retrieval_and_generation", "verification", "correction", "total"}
    assert traces.read(spark, f"{root}/traces").count() == 2 and traces.read(spark, f"{root}/no-such").count() == 0
    assert engine.health()["index_size"] == 4


def test_reranker_and_segmenter_of_a_configuration(spark, corpus):
    root, _, chunks = corpus
    q = spark.createDataFrame([("1", "network traffic address"), ("2", "ポッドはノードに")], "query_id string, query string")
    plain = Engine.build(spark, config(root, chunks)).retriever
    reranked = Engine.build(spark, config(root, chunks, rerank=True, reranker_model=None)).retriever
    assert isinstance(reranked, RerankingRetriever) and reranked.name == "bm25:char-bigram+fake" and reranked.search(q, 2).count() > 0
    with pytest.warns(RuntimeWarning):
        fallen = Engine.build(spark, config(root, chunks, segmenter="auto")).retriever
    assert sorted(map(tuple, fallen.search(q, 5).collect())) == sorted(map(tuple, plain.search(q, 5).collect()))
    with pytest.raises(RuntimeError):
        Engine.build(spark, config(root, chunks, rerank=True))
    with pytest.raises(ValueError):
        Engine.build(spark, config(root, chunks, segmenter="x"))
    got = EngineConfig.from_env({"QUILLON_RERANK": "1", "QUILLON_RERANKER": "fake", "QUILLON_SEGMENTER": "auto"})
    assert got.rerank and got.reranker_model is None and got.segmenter == "auto"


def test_an_index_cut_by_another_segmenter(spark, corpus):
    root, _, chunks = corpus
    cutting = {"cut": lambda text, lang: F.when(lang == "ja", F.split(text, "は")).otherwise(F.split(F.lower(text), " ")), "segmenter": "other"}
    first = tables.build_or_load(spark, chunks, f"{root}/cut")
    other = tables.build_or_load(spark, chunks, f"{root}/cut", **cutting)
    assert first.name == "bm25:char-bigram" and other.name == "bm25:other"
    assert other.postings.where("term = 'ポッド'").count() > 0 and bm25.query_terms(spark.createDataFrame([("1", "ポッドは何")], "query_id string, query string"), other.cut).count() == 2


def test_retrievers(spark, corpus):
    root, _, chunks = corpus
    q = spark.createDataFrame([("1", "network traffic address")], "query_id string, query string")
    sparse = Engine.build(spark, config(root, chunks, sparse_backend="fts5")).retriever
    hybrid = Engine.build(spark, config(root, chunks, retriever="hybrid"))
    assert sparse.name.startswith("fts5") and isinstance(hybrid.retriever, HybridRetriever) and hybrid.health()["index_size"] == -1
    top = sparse.search(q, 1).first().chunk_id
    assert top in {r.chunk_id for r in hybrid.retriever.search(q, 3).collect()}
    reranked = RerankingRetriever(sparse, providers.FakeReranker(), hybrid.chunks)
    assert reranked.search(q, 1).count() == 1
    dense = Engine.build(spark, config(root, chunks, retriever="dense"))
    lang = q.select("query_id", F.lit("ja").alias("lang"))
    ja = {r.chunk_id for r in hybrid.chunks.where("lang = 'ja'").collect()}
    assert {r.chunk_id for r in dense.retriever.search(q, 5, lang).collect()} == ja


def test_building_fails_clearly(spark, corpus):
    root, _, chunks = corpus
    with pytest.raises(FileNotFoundError, match="no-such"):
        Engine.build(spark, config(root, f"{root}/no-such"))
    for more in ({"retriever": "other"}, {"sparse_backend": "other"}, {"verifier_method": "other"}):
        with pytest.raises(ValueError):
            Engine.build(spark, config(root, chunks, **more))


def test_index_is_kept_while_current(spark, corpus):
    root, _, chunks = corpus
    at = f"{root}/kept"
    tables.build_or_load(spark, chunks, at)
    state = tables.source_state(spark, chunks)
    assert tables.is_current(spark, at, state) and not tables.is_current(spark, at, state | {"bytes": 1}) and not tables.is_current(spark, f"{root}/none", state)
    first = tables.load_index(spark, at)
    assert bm25.search(first, spark.createDataFrame([("1", "pods")], "query_id string, query string"), 2).count() == 2


def test_vectors_upsert(spark, corpus):
    root, _, chunks = corpus
    e, at, c = providers.FakeEmbedder(), f"{root}/upsert", tables.read_chunks(spark, chunks)
    assert tables.upsert_vectors(c, e, at).count() == 4 and tables.upsert_vectors(c.limit(2), e, at).count() == 4
    with pytest.raises(ValueError, match="32"):
        tables.upsert_vectors(c, providers.FakeEmbedder(32), at)


def test_evaluate_and_gate(spark, corpus, tmp_path, capsys):
    root, _, chunks = corpus
    gold = [{"id": "g1", "query": "routes traffic", "lang": "en", "topic": "t", "relevant_parallel_ids": ["docs/services.md"], "reference_answer": None, "answerable": True, "notes": ""},
            {"id": "g2", "query": "quantum", "lang": "ja", "topic": "t", "relevant_parallel_ids": [], "reference_answer": None, "answerable": False, "notes": ""}]
    items = [{"id": "f1", "lang": "en", "topic": "t", "evidence": ["a pod runs"], "claim": "a pod runs", "true_label": "supported", "notes": ""}]
    g, f = tmp_path / "gold.jsonl", tmp_path / "f.jsonl"
    g.write_text("\n".join(map(json.dumps, gold)))
    f.write_text("\n".join(map(json.dumps, items)) + "\n\n")
    engine = Engine.build(spark, config(root, chunks))
    r = engine.evaluate(tables.read_gold(spark, str(g))).where("lang is null").first()
    assert (r.n_items, r.n_answerable, r.recall_at_1) == (2, 1, 1.0)
    assert engine.evaluate_verifier(tables.read_faithfulness(spark, str(f))).where("n > 0").first()[:] == ("supported", "supported", 1)
    assert cli.main(["eval_gate", "--chunks", chunks, "--gold", str(g), "--items", str(f)]) == 0
    assert cli.main(["validate_gold", "--chunks", chunks, "--gold", str(g)]) == 0
    g.write_text(json.dumps(gold[0] | {"relevant_parallel_ids": ["docs/gone.md"]}))
    assert cli.main(["validate_gold", "--chunks", chunks, "--gold", str(g)]) == 1
    f.write_text("\n".join([json.dumps(items[0])] * 2))
    with pytest.raises(ValueError, match="duplicate"):
        tables.read_faithfulness(spark, str(f))


def test_ablation_arms(spark, corpus, tmp_path, capsys, monkeypatch):
    """Arms over fixed chunks and a second embedder, each with an index of its own, and a report history of runs."""
    root, docs, chunks = corpus
    fixed, g = f"{tmp_path}/fixed", tmp_path / "gold.jsonl"
    tables.write_lines(chunking.chunk_documents(docs, "fixed", target=12, overlap=0, least=1), fixed)
    g.write_text(json.dumps({"id": "g1", "query": "routes network traffic", "lang": "en", "topic": "t", "relevant_parallel_ids": ["docs/services.md"], "reference_answer": None, "answerable": True, "notes": ""}))
    for name, value in {"EMBEDDER": "fake", "LLM": "echo", "INDEX_DIR": f"{tmp_path}/v", "SPARSE_INDEX_PATH": f"{tmp_path}/s", "SPARSE_BACKEND": "fts5"}.items():
        monkeypatch.setenv(f"QUILLON_{name}", value)
    run = ["ablate", "--chunks", chunks, "--gold", str(g), "--arms", "sparse", "sparse@fixed", "dense", "dense@fixed", "dense@second"]
    assert cli.main([*run, "--fixed-chunks", fixed, "--second-embedder", "fake:16"]) == 0
    shown = capsys.readouterr().out
    assert all(f"|{arm}{more}" in shown.replace(" ", "") for arm in run[6:] for more in ("|", "_match_query|"))
    assert {tables.collection_state(spark, f"{tmp_path}/v{x}")["dim"] for x in ("", "-fixed")} == {64} and tables.collection_state(spark, f"{tmp_path}/v-second")["dim"] == 16
    assert tables.load_index(spark, f"{tmp_path}/s-fixed").count() > tables.load_index(spark, f"{tmp_path}/s").count()
    for bad in (["--arms", "sparse@fixed"], ["--arms", "sparse@other"], ["--arms", "sparse+x"]):
        with pytest.raises(ValueError):
            cli.main([*run[:5], *bad])
    for _ in range(2):
        assert cli.main(["run_eval", "--chunks", chunks, "--gold", str(g), "--retriever", "sparse", "--out", f"{tmp_path}/history"]) == 0
    assert reports.deltas(reports.history(spark, f"{tmp_path}/history")).where("lang is null").first().mrr_delta == 0


def test_config_from_env():
    c = EngineConfig.from_env({"QUILLON_EMBEDDER": "none", "QUILLON_LLM": "echo", "QUILLON_TOP_K": "7", "QUILLON_REFUSAL_THRESHOLD": "0.25", "QUILLON_ALLOW_FALLBACK": "Yes", "QUILLON_RETRIEVER": "sparse"})
    assert (c.embedder_model, c.llm_provider, c.top_k, c.refusal_threshold, c.allow_fallback, c.needs_embedder) == (None, None, 7, 0.25, True, False)
    assert EngineConfig.from_env({}) == EngineConfig() and EngineConfig().needs_embedder and EngineConfig(retriever="sparse", verifier_method="embedding").needs_embedder


def test_stream(spark, tmp_path):
    turns = spark.createDataFrame([(1, i, "assistant", "x" * (i + 1)) for i in range(6)], "conv_id long, turn long, role string, text string")
    traces.append(traces.from_turns(turns), f"{tmp_path}/log")
    q = monitor.refusal_rates(monitor.trace_stream(spark, f"{tmp_path}/log")).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("rates").collect()
    assert sum(r.n for r in got) == 6 and sum(r.refused for r in got) == 2


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# versions of stored things


def terms_table(spark, n):
    rng = random.Random(n)
    rows = [(f"c{i}", "stop " * 3 + " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randint(5, 20))), "en") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, text string, lang string")


def test_a_reader_goes_on_while_the_index_is_built_anew(spark, tmp_path):
    at, q = str(tmp_path / "index"), spark.createDataFrame([("q", "stop w1")], "query_id string, query string")
    with pytest.raises(FileNotFoundError):
        tables.load_index(spark, at)
    tables.save_index(bm25.build_index(terms_table(spark, 40)), at, {"n": 40})
    reader = tables.load_index(spark, at)
    before = bm25.search(reader, q, 40).collect()
    begun = tables.Versions(spark, at).begin()
    # an unfinished version is not seen, a finished one only by new readers
    assert tables.load_index(spark, at).count() == 40
    second = tables.save_index(bm25.build_index(terms_table(spark, 60)), at, {"n": 60})
    assert second > begun and tables.is_current(spark, at, {"n": 60}) and not tables.is_current(spark, at, {"n": 40})
    assert tables.load_index(spark, at).count() == 60 and reader.count() == 40 and bm25.search(reader, q, 40).collect() == before
    assert tables.load_index(spark, at, version=1).count() == 40
    with pytest.raises(Exception, match="lready exists"):
        tables.Versions(spark, at).finish(second, {})
    tables.Versions(spark, at).forget(keep=1)
    assert tables.load_index(spark, at).count() == 60
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_index(spark, at, version=1)


def test_postings_of_a_hot_term_are_many_files(spark, tmp_path):
    at = str(tmp_path / "index")
    tables.save_index(bm25.build_index(terms_table(spark, 3000)), at, {})
    rows = [r[0] for r in tables.load_index(spark, at).postings.groupBy(F.input_file_name()).count().select("count").collect()]
    hot = tables.load_index(spark, at).postings.where("term = 'stop'")
    assert hot.count() == 3000 and len(rows) >= 4 and max(rows) <= 2 * median(rows)
    assert hot.select(F.input_file_name()).distinct().count() >= 1


def rows_written(path, version):
    return sum(os.path.getsize(os.path.join(f, x)) for f, _, names in os.walk(f"{path}/v{version:08d}/data") for x in names if x.endswith(".parquet"))


def vectors_of(spark, ids, mark=""):
    return spark.createDataFrame([(f"{i:016x}", "T", ["S"], f"text {i}{mark}") for i in ids], "chunk_id string, title string, section_path array<string>, text string")


def test_an_upsert_writes_only_the_buckets_it_changes(spark, tmp_path):
    at, e = str(tmp_path / "vectors"), providers.FakeEmbedder()
    tables.upsert_vectors(vectors_of(spark, range(2000)), e, at, buckets=32)
    old = tables.read_vectors(spark, at)
    got = tables.upsert_vectors(vectors_of(spark, [3, 5000], "!"), e, at)
    assert got.count() == 2001 and {r.text for r in got.where("text like '%!'").collect()} == {"text 3!", "text 5000!"}
    assert rows_written(at, 2) < rows_written(at, 1) / 10
    assert old.count() == 2000 and old.where("text = 'text 3'").count() == 1
    assert tables.upsert_vectors(vectors_of(spark, []), e, at).count() == 2001
    twice = vectors_of(spark, [7, 7, 8]).withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string")))
    assert tables.upsert_vectors(twice.union(twice.limit(1).withColumn("chunk_id", F.lit(None).cast("string"))), e, at).count() == 2001
    whole = {tuple(r) for r in tables.read_vectors(spark, at).select("chunk_id", "text", "point_id").collect()}
    tables.Versions(spark, at).forget(keep=1)
    assert {tuple(r) for r in tables.read_vectors(spark, at).select("chunk_id", "text", "point_id").collect()} == whole
    assert {tuple(r) for r in tables.compact_vectors(spark, at).select("chunk_id", "text", "point_id").collect()} == whole
    tables.Versions(spark, at).forget(keep=1)
    assert len([x for x in os.listdir(at) if x.startswith("v")]) == 1 and tables.read_vectors(spark, at).count() == 2001
    with pytest.raises(ValueError):
        tables.upsert_vectors(vectors_of(spark, [1]), providers.FakeEmbedder(32), at)


# the trace log and the report history


def made_traces(spark, ids):
    turns = spark.createDataFrame([(i, 1, "assistant", "x" * (i % 5 + 1)) for i in ids], "conv_id long, turn int, role string, text string")
    return traces.from_turns(turns)


def test_a_replayed_stream_doubles_no_trace(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    assert traces.read_log(spark, log).count() == 0

    def run():
        traces.sink(monitor.trace_stream(spark, source), log).awaitTermination()
        return sorted(r.trace_id for r in traces.read_log(spark, log).collect())

    traces.append(made_traces(spark, range(0, 3000, 100)), source)
    first = run()
    assert len(first) == 30
    # sent again with others, far older ones among them; and a trace twice in one batch
    traces.append(made_traces(spark, [*range(0, 3000, 100), 50, 50, 2950]), source)
    second = run()
    assert second == sorted({*first, "50-1", "2950-1"})
    assert run() == second
    # the last batch fails after its rows are written and is run again
    commits = tmp_path / "log" / "_checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (commits / name).unlink()
    assert run() == second
    whole = monitor.refusal_rates(made_traces(spark, [*range(0, 3000, 100), 50, 2950]))
    assert sorted(map(tuple, monitor.refusal_rates(traces.read_log(spark, log)).collect())) == sorted(map(tuple, whole.collect()))


def test_reports_are_kept_and_compared(spark, tmp_path):
    at = str(tmp_path / "history")
    row = lambda lang, x: (lang, 10, 8, *[x] * 6)
    schema = "lang string, n_items long, n_answerable long, " + ", ".join(f"{m} double" for m in reports.METRICS)
    make = lambda *rows: spark.createDataFrame(rows, schema)
    reports.append(make(row("en", 0.5), row(None, 0.25)), at, "a", "2024-01-02T00:00:00Z")
    assert reports.deltas(reports.history(spark, at)).count() == 0
    runs = [reports.append(make(row("en", 0.75), row(None, 0.5)), at, "a", "2024-01-03T00:00:00Z"), reports.append(make(row("en", 0.25)), at, "a", "2024-01-01T00:00:00Z")]
    reports.append(make(row("en", 1.0), row("fr", None)), at, "b", "2024-01-03T00:00:00Z")
    assert len(set(runs)) == 2 and reports.history(spark, at).count() == 7
    got = {(r.name, r.lang, r.previous_at[:10], r.generated_at[:10]): r.mrr_delta for r in reports.deltas(reports.history(spark, at)).collect()}
    assert got == {("a", "en", "2024-01-01", "2024-01-02"): 0.25, ("a", "en", "2024-01-02", "2024-01-03"): 0.25, ("a", None, "2024-01-02", "2024-01-03"): 0.25}
    assert reports.stamp(0) == "1970-01-01T00:00:00Z"
