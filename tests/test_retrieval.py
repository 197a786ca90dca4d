"""BM25 against a plain implementation; dense search, fusion and reranking."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import blockmax, bm25, dense
from quillon.operators.providers import FakeReranker
from quillon.sources import tables

DOCS = {"a": "Pod containers run in a pod", "b": "containers are isolated", "c": "a service routes traffic", "d": "nodes run pods and containers in the cluster"}


def okapi(docs, query):
    tok = {i: t.lower().split() for i, t in docs.items()}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = {w: sum(w in t for t in tok.values()) for t in tok.values() for w in t}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    out = {}
    for i, t in tok.items():
        if set(t) & set(query):
            out[i] = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query)
    return out


def index(spark, docs, lang="en"):
    return bm25.build_index(spark.createDataFrame([(i, t, lang) for i, t in docs.items()], "chunk_id string, text string, lang string"))


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


@pytest.mark.parametrize("query", ["pod containers", "run run pods", "missing", "a OR NOT containers"])
def test_okapi(spark, query):
    got = {r.chunk_id: r.score for r in bm25.search(index(spark, DOCS), asked(spark, query), 10).collect()}
    want = okapi(DOCS, query.lower().split())
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_negative_floor(spark):
    docs = {"x": "shared one two three", "y": "shared four five six seven eight nine"}
    ix = index(spark, docs)
    idf = {r.term: r.idf for r in ix.term_idf.collect()}
    assert idf["shared"] == pytest.approx(0.25 * (math.log(0.5) - math.log(2.5)) / 10, abs=1e-4)


def test_language_filter_keeps_statistics(spark):
    df = spark.createDataFrame([("a", "pod run", "en"), ("b", "pod go", "fr"), ("c", "other words", "en")], "chunk_id string, text string, lang string")
    ix, q = bm25.build_index(df), asked(spark, "pod")
    some = bm25.search(ix, q, 5, q.select("query_id", F.lit("fr").alias("lang"))).collect()
    whole = {r.chunk_id: r.score for r in bm25.search(ix, q, 5).collect()}
    assert [(r.chunk_id, r.score) for r in some] == [("b", whole["b"])]


def test_filling(spark):
    got = bm25.search(index(spark, DOCS), asked(spark, "service"), 3, fill_zero_scores=True).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c", "a", "b"] and got[1].score == 0


def test_japanese_queries(spark):
    ix = index(spark, {"x": "ポッドは最小の単位です", "y": "サービスは通信を分配します"}, "ja")
    assert bm25.search(ix, asked(spark, "ポッドとは"), 1).first().chunk_id == "x"


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "en"), ("b", [0.6, 0.8], "fr"), ("c", [0.0, 0.0], "en"), ("d", [2.0, 0.1], "fr")], "chunk_id string, embedding array<double>, lang string")
    q = spark.createDataFrame([("q", [1.0, 0.0], None), ("r", [1.0, 0.0], "fr")], "query_id string, embedding array<double>, wanted string")
    got = dense.dense_search(v, q, 3, filter_col="lang").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [("q", "a"), ("q", "d"), ("q", "b"), ("r", "d"), ("r", "b")]
    assert got[2].score == pytest.approx(0.6)


def nearest_by_hand(vectors, queries, k):
    out = []
    for qid in {q for q, v, _ in queries if q is not None and v is not None}:
        best = {}
        for cid, v, lang in vectors:
            for q, w, want in queries:
                if q != qid or w is None or v is None or cid is None or want not in (None, lang) or None in v or not all(map(math.isfinite, v)):
                    continue
                norm = math.hypot(*v) * math.hypot(*w)
                best[cid] = max(best.get(cid, -2.0), sum(x * y for x, y in zip(v, w, strict=True)) / norm if norm else 0.0)
        order = sorted(best, key=lambda c: (-round(best[c], 9), c))[:k]
        out += [(qid, i + 1, c, round(best[c], 7)) for i, c in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [dense.QUERY_BYTES, 0])
@pytest.mark.parametrize("k", [1, 7])
def test_dense_equals_brute_force(spark, monkeypatch, query_bytes, k):
    """Ties, repeated ids on both sides, nulls; queries sent to all tasks or dealt into blocks."""
    rng = random.Random(4)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    vectors = [(f"c{rng.randrange(120)}", vec(), rng.choice(["en", "fr", None])) for _ in range(300)] + [(f"t{i:03}", [1.0, 1.0, 0.0], "en") for i in range(200)]
    vectors += [(None, vec(), "en"), ("null", None, "en"), ("holes", [1.0, None, 0.0], "en"), ("nan", [math.nan, 1.0, 0.0], "en"), ("inf", [math.inf, 1.0, 0.0], "en")]
    queries = [(f"q{i}", vec(), rng.choice([None, "en", "fr", "xx"])) for i in range(20)] + [("q1", vec(), None), ("q1", vec(), "en"), ("none", None, None), (None, vec(), None)]
    queries += [queries[2], ("t", [1.0, 1.0, 0.0], None), ("zero", [0.0, 0.0, 0.0], "en")]
    monkeypatch.setattr(dense, "GRID_QUERIES", 8)
    monkeypatch.setattr(dense, "GRID_VECTORS", 100)
    v = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>, lang string")
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>, wanted string")
    got = dense.dense_search(v, q, k, filter_col="lang", query_bytes=query_bytes)
    assert sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in got.collect()) == nearest_by_hand(vectors, queries, k)
    assert dense.dense_search(v.where("false"), q, k, query_bytes=query_bytes).collect() == []
    assert dense.dense_search(v, q.where("false"), k, query_bytes=query_bytes).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        dense.dense_search(v.union(v.limit(1).withColumn("embedding", F.array(F.lit(1.0)))), q, k, query_bytes=query_bytes).collect()


def test_cosine_and_size_guard(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(dense.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(2**-0.5)]
    with pytest.raises(Exception, match="size is not 3"):
        dense.require_dim(df, "a", 3).collect()


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, score double")


def test_fusion_counts_ranks_only(spark):
    a = hits(spark, [("q", 1, "x", 900.0), ("q", 2, "y", 1.0)])
    b = hits(spark, [("q", 1, "y", 0.1), ("q", 2, "z", 0.01)])
    got = dense.fuse(a, b, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["y", "x", "z"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_rerank_replaces_scores(spark):
    chunks = spark.createDataFrame([(c, c * 3) for c in "xyz"], "chunk_id string, text string")
    q = asked(spark, "hello").withColumn("query_id", F.lit("q"))
    r = FakeReranker()
    got = dense.rerank(hits(spark, [("q", 1, "x", 3.0), ("q", 2, "y", 2.0), ("q", 3, "z", 1.0)]), q, chunks, r.score(F.col("query"), F.col("text")), 2).collect()
    assert len(got) == 2 and all(0 <= x.score < 1 for x in got)
    again = dense.rerank(hits(spark, [("q", 1, "x", 3.0), ("q", 2, "y", 2.0), ("q", 3, "z", 1.0)]), q, chunks, r.score(F.col("query"), F.col("text")), 2).collect()
    assert got == again


def block_corpus(spark, n=1500):
    rng = random.Random(9)
    vocab = {la: [f"{la}{i}" for i in range(300)] + ["the", "of"] for la in ("en", "fr")}
    rows = []
    for i in range(n):
        la = rng.choice(["en", "fr"])
        weights = [1 / (j + 2) for j in range(300)] + [3, 2]
        rows.append((i, " ".join(rng.choices(vocab[la], weights, k=rng.randint(1, 120))), la))
    rows += [(n, "", "en"), (n + 1, None, "en"), (n + 2, "en7 en9", None)]
    return spark.createDataFrame(rows, "chunk_id long, text string, lang string"), [" ".join(rng.choices(vocab[la], k=rng.randint(1, 12))) for la in ("en", "fr") * 10] + ["the", "the of", "absent", ""]


@pytest.mark.parametrize("filtered", [False, True])
def test_block_search_equals_the_whole_search(spark, filtered):
    chunks, texts = block_corpus(spark)
    queries = asked(spark, *texts)
    lang = queries.select("query_id", F.when(F.col("query").contains("en"), "en").otherwise("fr").alias("lang")) if filtered else None
    whole = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 7)) for r in bm25.search(bm25.build_index(chunks), queries, 7, lang).collect()}
    index = blockmax.block_index(tables.kept(blockmax.blocked(chunks)), tables.kept)
    assert index.blocks.agg(F.max("n")).first()[0] <= blockmax.BLOCK_CHUNKS
    found = blockmax.block_search(index, queries, tables.kept, 7, lang)
    assert {(r.query_id, r.rank): (r.chunk_id, round(r.score, 7)) for r in found.hits.collect()} == whole
    held, read = found.places.agg(F.sum("n"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0))).first()
    assert 0 < read < 0.8 * held


def test_block_search_with_few_blocks_and_no_rows(spark):
    chunks, texts = block_corpus(spark, 40)
    index = blockmax.block_index(tables.kept(blockmax.blocked(chunks)), tables.kept)
    queries = asked(spark, *texts)
    want = sorted((r.query_id, r.chunk_id) for r in bm25.search(bm25.build_index(chunks), queries, 100).collect())
    assert sorted((r.query_id, r.chunk_id) for r in blockmax.block_search(index, queries, tables.kept, 100, first_blocks=1).hits.collect()) == want
    assert blockmax.block_search(index, queries.where("false"), tables.kept).hits.collect() == []
    none = blockmax.block_index(tables.kept(blockmax.blocked(chunks.where("false"))), tables.kept)
    assert blockmax.block_search(none, queries, tables.kept).hits.collect() == []
