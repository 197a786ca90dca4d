"""Claims, verification arms and the correction policy."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.operators import correction, prompts, verification
from quillon.operators.providers import EchoProvider, FakeEmbedder, get_decomposer, get_embedder, get_llm, get_reranker, get_segmenter, get_token_counter, get_verifier

CLAIMS = "answer_id string, claim_index int, claim string"
EVIDENCE = "answer_id string, evidence_index int, evidence string"


def by_index(df):
    return {r.claim_index: r for r in df.collect()}


def test_lexical(spark):
    claims = spark.createDataFrame([("x", 0, "Pods run containers"), ("x", 1, "unrelated words entirely"), ("x", 2, "!!!"), ("y", 3, "no evidence here"), ("x", 4, "ポッドは単位")], CLAIMS)
    ev = spark.createDataFrame([("x", 0, "nothing"), ("x", 1, "pods run on nodes"), ("x", 2, "containers run in pods, pods run"), ("x", 3, "ポッドは単位です")], EVIDENCE)
    got = by_index(verification.lexical(claims, ev))
    assert (got[0].label, got[0].score, got[0].best_evidence_index) == ("supported", 1.0, 2)
    assert (got[1].label, got[1].score, got[1].best_evidence_index) == ("unsupported", 0.0, None)
    assert got[2].score == 0 and got[3].best_evidence_index is None and got[4].label == "supported"


def test_first_evidence_wins_ties(spark):
    claims = spark.createDataFrame([("x", 0, "a b c d e")], CLAIMS)
    ev = spark.createDataFrame([("x", 1, "a b c"), ("x", 0, "c d e")], EVIDENCE)
    r = by_index(verification.lexical(claims, ev))[0]
    assert (r.best_evidence_index, r.label, r.score) == (0, "supported", pytest.approx(0.6))


def test_nli_rule(spark):
    claims = spark.createDataFrame([("x", i, "c") for i in range(4)], CLAIMS)
    p = spark.createDataFrame([("x", 0, 0, 0.5, 0.4), ("x", 0, 1, 0.2, 0.9), ("x", 1, 0, 0.3, 0.6), ("x", 1, 1, 0.1, 0.9), ("x", 2, 0, 0.3, 0.1), ("x", 2, 1, 0.1, 0.9)],
                              "answer_id string, claim_index int, evidence_index int, entailment double, contradiction double")
    got = by_index(verification.nli(claims, p))
    assert [got[i].label for i in range(4)] == ["supported", "contradicted", "unsupported", "unsupported"]
    assert got[0].best_evidence_index == 0 and got[3].best_evidence_index is None


def test_embedding_arm(spark):
    e = FakeEmbedder()
    claims, ev = spark.createDataFrame([("x", 0, "same text"), ("x", 1, "other")], CLAIMS), spark.createDataFrame([("x", 0, "zzzz"), ("x", 1, "same text")], EVIDENCE)
    c = claims.withColumn("claim_vec", e.embed_passages(F.col("claim")))
    got = by_index(verification.embedding(c, ev.withColumn("evidence_vec", e.embed_passages(F.col("evidence")))))
    assert got[0].label == "supported" and got[0].best_evidence_index == 1 and got[1].label == "unsupported"


def test_fake_and_judge(spark):
    claims, ev = spark.createDataFrame([("x", 0, "one"), ("y", 1, "two")], CLAIMS), spark.createDataFrame([("x", 0, "e")], EVIDENCE)
    r = int.from_bytes(hashlib.blake2b(b"one", digest_size=8).digest(), "big") / 2**64
    got = by_index(verification.fake(claims, ev))
    assert got[0].score == r and got[0].label == ("supported" if r < 0.34 else "contradicted" if r < 0.5 else "unsupported") and got[1].score == 0
    judged = by_index(verification.judged(claims, ev, EchoProvider()))
    assert judged[0].label == "unsupported" and judged[0].best_evidence_index is None


def test_claims_and_rates(spark):
    a = spark.createDataFrame([("x", "One. Two! Three."), ("y", "")], "answer_id string, text string")
    c = verification.sentence_claims(a)
    assert [r.claim for r in c.orderBy("claim_index").collect()] == ["One.", "Two!", "Three."]
    rate = {r.answer_id: r for r in verification.faithfulness(c.withColumn("label", F.when(F.col("claim_index") < 2, "supported").otherwise("unsupported")), a).collect()}
    assert rate["x"].faithfulness_rate == pytest.approx(2 / 3) and rate["y"].faithfulness_rate is None and rate["y"].n_claims == 0


VERDICTS = "answer_id string, claim_index int, claim string, label string, score double, best_evidence_index int, method string"


def policy(spark, labels, found, threshold=0.5, question="why?"):
    v = spark.createDataFrame([("x", i, f"claim {i}", lab, 0.1, None, "m") for i, lab in enumerate(labels)], VERDICTS)
    search = lambda q: q.select("query_id", F.lit(1).alias("rank"), (F.col("query") if found else F.lit("nothing")).alias("text"))
    d = correction.decide(v, correction.retry(v, search))
    a = spark.createDataFrame([("x", question, "the text")], "answer_id string, question string, text string")
    return d, correction.corrected(a, d, threshold).first()


def test_actions(spark):
    d, a = policy(spark, ["supported", "contradicted", "unsupported"], True)
    got = by_index(d)
    assert [got[i].action for i in range(3)] == ["kept", "struck", "recovered"]
    assert got[2].final_label == "supported" and got[2].label == "unsupported" and got[1].final_label == "contradicted"
    assert a.final_text == "claim 0 claim 2" and not a.refused


def test_failed_retry_shows_the_first_result(spark):
    d, a = policy(spark, ["unsupported"], False)
    r = by_index(d)[0]
    assert r.action == "struck" and r.final_label == "unsupported" and r.final_score == 0.1
    assert a.refused and a.final_text == correction.REFUSAL_EN and a.refusal_reason.startswith("only 0/1 claims")


def test_refusal_is_strict(spark):
    assert not policy(spark, ["supported", "contradicted"], False)[1].refused
    assert policy(spark, ["supported", "contradicted", "contradicted"], False)[1].refused
    assert policy(spark, ["contradicted"], False, question="なぜですか")[1].final_text == correction.REFUSAL_JA


def test_no_claims_stay(spark):
    v = spark.createDataFrame([], VERDICTS)
    a = spark.createDataFrame([("x", "q", "as it was")], "answer_id string, question string, text string")
    got = correction.corrected(a, correction.decide(v, spark.createDataFrame([], VERDICTS))).first()
    assert got.final_text == "as it was" and got.refused is False and got.refusal_reason is None


def test_a_refusal_speaks_as_the_question_does(spark, tmp_path):
    """The user's last words before an answer choose the text; not the answer, later words, a turn without words, or another conversation."""
    ja, en, a = "なぜですか", "Why is that?", "Nothing known about."
    turns = [
        (1, 0, "user", ja), (1, 1, "assistant", a), (2, 0, "user", en), (2, 1, "assistant", "ポッドは単位です。"),
        (3, 0, "user", ja), (3, 1, "assistant", a), (3, 2, "user", en), (3, 3, "assistant", a), (3, 4, "assistant", "Other words."), (3, 5, "user", ja),
        (4, 0, "system", ja), (4, 1, "assistant", a), (4, 2, "user", ja), (5, 0, "user", ja), (5, 2, "user", en), (5, 2, "user", ja), (5, 2, "system", ja), (5, 10, "assistant", a),
        (6, 0, "user", en), (6, 1, "user", ja), (6, 2, "user", None), (6, 3, "assistant", a), (7, 0, "user", ja), (7, 1, "user", "Pods run containers"), (7, 2, "assistant", "Pods run. Containers run!"),
    ]
    random.Random(4).shuffle(turns)
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "unrelated passage"), (1, "of other things")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = __spark_entry__.queries()["corrected_answers"](spark, str(tmp_path))
    rows = {r.answer_id: r for r in got.collect()}
    said = {i: "ja" if r.final_text == correction.REFUSAL_JA else "en" if r.final_text == correction.REFUSAL_EN else r.final_text for i, r in rows.items()}
    assert said == {1001: "ja", 2001: "en", 3001: "ja", 3003: "en", 3004: "en", 4001: "en", 5010: "en", 6003: "ja", 7002: "Pods run. Containers run!"}
    db = duckdb.connect()
    for name in ("conversations", "benchmark"):
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = db.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()['corrected_answers']})").fetchall()
    assert len(want) == len(rows) and {tuple(r) for r in rows.values()} == set(want)


def test_prompts(spark):
    hits = spark.createDataFrame([("q", 2, "T2", [], "b"), ("q", 1, "T1", ["S", "U"], "a")], "query_id string, rank int, title string, section_path array<string>, text string")
    q = spark.createDataFrame([("q", "what?"), ("r", "none?")], "query_id string, question string")
    got = {r.query_id: r.prompt for r in prompts.build_prompts(q, hits).collect()}
    assert got["q"].endswith("Sources:\n[1] (T1 › S › U)\na\n\n[2] (T2)\nb\n\nQuestion: what?") and prompts.NO_SOURCES in got["r"]
    echoed = spark.createDataFrame([("abc",)], "p string").select(prompts.echo(F.col("p"))).first()[0]
    assert echoed == "[ECHO — no model called. Prompt was 3 chars.]"


def test_factories(spark):
    assert get_embedder(None).name.startswith("fake") and get_reranker(None).name == "fake" and get_llm(None).name == "echo" and get_token_counter(None).name == "heuristic"
    for make in (get_embedder, get_reranker):
        with pytest.raises(RuntimeError):
            make("no-such-model")
    with pytest.warns(RuntimeWarning):
        assert get_llm("groq").name == "echo"
    with pytest.warns(RuntimeWarning):
        assert get_segmenter("ja")[0] == "char-bigram"
    with pytest.raises(RuntimeError):
        get_segmenter("ja", allow_fallback=False)
    assert get_segmenter("fr")[0] == "whitespace" and get_verifier("lexical") is verification.lexical
    for bad in ("embedding", "llm-judge", "other"):
        with pytest.raises(ValueError):
            get_verifier(bad)
    with pytest.raises(RuntimeError):
        get_verifier("nli")
    with pytest.raises(ValueError):
        get_decomposer("llm")
    with pytest.raises(ValueError):
        get_decomposer("other")


def test_fake_embedder_is_unit_and_asymmetric(spark):
    e = FakeEmbedder()
    df = spark.createDataFrame([("Hello world",), ("",)], "t string")
    q, p = (df.select(f(F.col("t"))).collect() for f in (e.embed_query, e.embed_passages))
    assert sum(x * x for x in q[0][0]) == pytest.approx(1) and q[0][0] != p[0][0] and not any(q[1][0])


def test_fakes_of_many_rows_are_their_hashes(spark):
    """Embedder, reranker and verifier without meaning, every row against hashlib."""
    rng = random.Random(8)
    texts = ["", " ", "ab", "ÀB ç"] + ["".join(rng.choices("abc dé。", k=rng.randint(1, 60))) for _ in range(120)]
    digest = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")

    def vector(t, salt, dim=64):
        t, v = t.strip().lower(), [0.0] * dim
        for size in (3, 4, 5):
            for i in range(len(t) - size + 1):
                v[digest(f"{salt}:{t[i : i + size]}") % dim] += 1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v

    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "i int, t string, a int")
    e = FakeEmbedder()
    got = df.select("i", e.embed_passages(F.col("t")).alias("p"), e.embed_query(F.col("t")).alias("q"), get_reranker(None).score(F.col("t"), F.concat("t", F.lit("x"))).alias("s")).collect()
    for r in got:
        t = texts[r.i]
        assert r.p == pytest.approx(vector(t, "p")) and r.q == pytest.approx(vector(t, "q")) and r.s == pytest.approx(digest(f"{t}:{t}x") / 2**64)
    claims = df.select(F.col("a").alias("answer_id"), F.col("i").alias("claim_index"), F.col("t").alias("claim"))
    evidence = spark.createDataFrame([(0, 0, "x"), (1, 0, "y")], "answer_id int, evidence_index int, evidence string")
    for r in verification.fake(claims, evidence).collect():
        x = digest(r.claim) / 2**64
        want = ("unsupported", 0.0, None) if r.answer_id == 2 else ("supported" if x < 0.34 else "contradicted" if x < 0.5 else "unsupported", x, 0)
        assert (r.label, pytest.approx(r.score), r.best_evidence_index) == want
