"""The pipeline against a brute-force version on a small fixture."""

import re

import corpus_pipeline
from quillon.llm import pii, toxicity


def test_pipeline(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(30))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "A calm text about nothing in particular. It goes on.", "en", "s0"),
        (2, "You are a worthless idiot, said nobody here today.", "en", "s0"),
        (3, long, "en", "s0"), (4, long + " more", "en", "s1"), (5, long, "fr", "s1"),
        (6, "Before it " + item + " and after it", "en", "s1"),
        (7, "write to jane.doe@mail.example.com or call +1 (555) 123-4567", "en", "s2"),
        (8, None, None, None), (9, "", "de", "s2"), (1, "A calm text about nothing in particular. It goes on.", "en", "s0"), (None, "a row without an id", "en", "s3"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # brute force: insults go, one of each near group, no passage, personal data replaced, every row at least once
    bad = set(toxicity.LEXICON[toxicity.INSULT].split())
    want, seen = {}, []
    for i, t, _, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").lower().split()
        if bad & set(re.findall(r"[a-z']+", (t or "").lower())) or item in (t or ""):
            continue
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if i is not None and any(s and len(s & o) >= 0.8 * len(s | o) for o in seen):
            continue
        seen.append(s)
        want[i] = t
    want[7] = "write to [EMAIL] or call [PHONE]"
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got if r.doc_id == 7 or r.text is None)
    assert {n for n, _ in corpus_pipeline.STAGES} == {"toxicity", "near_duplicates", "decontamination", "pii", "mixing"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.mix(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert len(pii.train(docs.where("false")).trees) == 0
