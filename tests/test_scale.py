"""What searches move: postings or query terms, never the rows in which both meet."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import blockmax, bm25, correction
from quillon.plans import catalog
from quillon.sources import tables

from test_retrieval import DOCS, asked, index, okapi
from test_verification import VERDICTS

QUERIES = ("pod containers", "run run pods", "missing", "in a cluster", "routes")


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("made", [bm25.scores, bm25.candidates])
def test_pairs_of_query_and_chunk_are_not_shuffled(spark, made):
    ix = index(spark, DOCS)
    pairs = made(ix, bm25.query_terms(asked(spark, *QUERIES), ix.cut))
    assert not [e for e in exchanges(pairs) if "query_id" in e and "chunk_id" in e]


@pytest.mark.parametrize("limit", [1 << 20, 20, 0])
def test_every_way_of_dealing_gives_the_same_scores(spark, monkeypatch, limit):
    """Terms sent to postings, postings sent to terms, both shuffled."""
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", limit)
    many = [*QUERIES, *QUERIES, *QUERIES]
    ix = index(spark, DOCS)
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.search(ix, asked(spark, *many), 10).collect()}
    want = {(f"q{i}", c): s for i, q in enumerate(many) for c, s in okapi(DOCS, q.split()).items()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_block_search_neither_writes_nor_shuffles_pairs_of_query_and_block(spark, monkeypatch, limit):
    """Blocks of one text; some queries ask for a language, one has no word that is there."""
    monkeypatch.setattr(blockmax, "BROADCAST_TERMS", limit, raising=False)
    rows = [(i, t, "fr" if n % 2 else "en") for n, (i, t) in enumerate(sorted((DOCS | {f"x{n}": f"pod n{n} containers" for n in range(30)}).items()))]
    chunks = spark.createDataFrame([*rows, ("z", "pod routes", None)], "chunk_id string, text string, lang string")
    queries, written = asked(spark, *QUERIES), []
    lang = queries.where("query_id in ('q0', 'q4')").select("query_id", F.lit("en").alias("lang"))

    def kept(df):
        written.append(set(df.columns))
        return tables.kept(df)

    ix = blockmax.block_index(tables.kept(blockmax.blocked(chunks)), tables.kept)
    for of in (None, lang):
        hits = blockmax.block_search(ix, queries, kept, 3, of).hits
        if limit:
            assert not [e for e in exchanges(hits) if "query_id" in e and "block" in e]
        want = bm25.search(bm25.build_index(chunks), queries, 3, of)
        assert {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in hits.collect()} == {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in want.collect()}
    assert not [w for w in written if {"query_id", "block"} <= w]


def test_a_claim_of_many_answers_is_looked_up_once(spark):
    v = spark.createDataFrame([(a, i, c, "unsupported", 0.0, None, "m") for a in ("x", "y", "z") for i, c in enumerate(("same claim", f"claim of {a}", "same claim"))], VERDICTS)
    seen = []

    def search(q):
        seen.extend(r.query for r in q.collect())
        return q.select("query_id", F.lit(1).alias("rank"), F.when(F.col("query") == "same claim", F.col("query")).otherwise("nothing").alias("text"))

    again = {(r.answer_id, r.claim_index): r.label for r in correction.retry(v, search).collect()}
    assert sorted(seen) == ["claim of x", "claim of y", "claim of z", "same claim"]
    assert again == {(a, i): "unsupported" if i == 1 else "supported" for a in ("x", "y", "z") for i in range(3)}


def test_both_arms_share_one_gold_table(spark, monkeypatch):
    made, gold = [], catalog._gold
    monkeypatch.setattr(catalog, "_gold", lambda *a: made.append(1) or gold(*a))
    assert catalog.ablation_table(spark, "/root/testdata/sf0.001").count() == 6 and len(made) == 1
