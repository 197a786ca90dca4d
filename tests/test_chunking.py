"""Chunkers against a plain model of the greedy rule, with every kind of counter."""

import itertools
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import markdown
from quillon.operators import chunking, counters


def plain_windows(sizes, target, overlap):
    """The rule as stated: fill greedily, step back over about ``overlap``, always go on."""
    out, i = [], 0
    while i < len(sizes):
        j = i + 1
        while j < len(sizes) and sum(sizes[i : j + 1]) <= target:
            j += 1
        out.append((i, j))
        if j == len(sizes):
            break
        k = j
        if overlap > 0:
            while k > i + 1 and sum(sizes[k:j]) < overlap:
                k -= 1
        i = k
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 60), st.integers(0, 70))
def test_windows(sizes, target, overlap):
    got = chunking.windows(sizes, target, overlap)
    assert got == plain_windows(sizes, target, overlap)
    assert all(a < b for a, b in zip([w[0] for w in got], [w[0] for w in got][1:], strict=False))
    assert {x for i, j in got for x in range(i, j)} == set(range(len(sizes)))


def page(spark, blocks, lang="en"):
    df = spark.createDataFrame([("docs/a.md", lang, "T", "u", "sha", [{"section_path": p, "text": t} for p, t in blocks])],
                               "parallel_id string, lang string, title string, url string, commit_sha string, blocks array<struct<section_path:array<string>,text:string>>")
    return df


LONG = " ".join(["This sentence is made of some forty letters."] * 40)


def test_structural_sections(spark):
    got = chunking.chunk_structural(page(spark, [(["A"], LONG), (["B"], LONG)]), 128, 32, 16).orderBy("ordinal").collect()
    assert {tuple(r.section_path) for r in got} == {("A",), ("B",)} and [r.ordinal for r in got] == list(range(len(got)))
    assert all(16 <= r.token_count <= 140 for r in got) and len({r.chunk_id for r in got}) == len(got)


def test_small_sections_are_carried(spark):
    got = chunking.chunk_structural(page(spark, [(["A", "B1"], "Tiny."), (["A", "B2"], LONG), (["A", "B3"], "Scrap.")]), 2000, 0, 16).collect()
    assert len(got) == 1 and got[0].section_path == ["A"] and got[0].text.startswith("Tiny.") and got[0].text.endswith("\n\nScrap.")


def test_a_short_page_is_one_chunk(spark):
    got = chunking.chunk_structural(page(spark, [(["A"], "Only this.")])).collect()
    assert [(r.text, r.ordinal, r.section_path) for r in got] == [("Only this.", 0, ["A"])]
    assert chunking.chunk_structural(page(spark, [])).count() == 0


def test_blocks_of_one_path_join(spark):
    got = page(spark, [(["A"], "x"), (["A"], "y"), (["B"], "z"), (["A"], "w")]).select(chunking.grouped_sections(F.col("blocks"))).first()[0]
    assert [(list(s.section_path), s.text) for s in got] == [(["A"], "x\n\ny"), (["B"], "z"), (["A"], "w")]


def test_fixed_ignores_sections(spark):
    got = chunking.chunk_fixed(page(spark, [(["A"], LONG), (["B"], LONG)]), 128, 32, 16).orderBy("ordinal").collect()
    assert got[0].section_path == ["A"] and got[-1].section_path == ["B"] and any("letters. This" in r.text for r in got)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        chunking.chunk_documents(None, "other")


def test_documents_to_chunks_and_manifest(spark):
    docs = spark.createDataFrame([("docs/a.md", "en", "T", "u", "# A\n" + LONG, "s"), ("docs/a.md", "ja", "T", "u", "", "s")], "parallel_id string, lang string, title string, url string, body string, commit_sha string")
    chunks = chunking.chunk_documents(docs, target=128, overlap=32, least=16)
    m = chunking.manifest(docs, chunks, strategy="structural").first()
    assert m.pages == 2 and m.documents_yielding_no_chunks == 1 and m.chunks_by_lang == {"en": chunks.count()} and m.strategy == "structural"
    s = chunking.corpus_stats(docs, "s").first()
    assert (s.en_pages, s.ja_pages, s.parallel_pages, s.en_only_pages) == (1, 1, 1, 0)


# counters


def plain_structural(blocks, target, overlap, least, count):
    """Sections, carry, windows and the last scrap, one after the other."""
    sections = [(list(p), "\n\n".join(t for _, t in g)) for p, g in itertools.groupby(blocks, key=lambda b: b[0])]
    common = lambda a, b: [x for x, _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False))]
    out, carry = [], None
    for path, text in sections:
        if carry:
            path, text = common(carry[0], path), carry[1] + "\n\n" + text
        carry = (path, text) if count(text) < least else None
        if carry:
            continue
        units = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if s.strip()]
        for i, j in plain_windows([count(u) for u in units], target, overlap):
            piece = " ".join(units[i:j])
            if count(piece) >= least:
                out.append((path, piece))
    if carry and out:
        out[-1] = common(out[-1][0], carry[0]), out[-1][1] + "\n\n" + carry[1]
    elif carry:
        out = [carry]
    return [(p, t, count(t)) for p, t in out]


VOCABULARY = [("\u2581", -3.0), ("\u2581th", -2.0), ("is", -2.5), ("\u2581this", -3.2), ("e", -2.0), ("nd", -2.0), ("en", -2.2), ("ence", -4.0), ("\u2581sent", -3.0), ("s", -2.0), ("t", -2.0), ("ab", -1.0), ("b", -1.5), ("a", -1.5)]


def made_blocks(rng, n):
    words = ["This", "sentence", "ends", "abba", "x", "tent", "日本", "thé"]
    text = lambda: ". ".join(" ".join(rng.choices(words, k=rng.randint(1, 9))).capitalize() for _ in range(rng.randint(1, 6))) + "."
    return [([rng.choice("AB"), *rng.choice([[], ["C"], ["D", "E"]])], text()) for _ in range(n)]


def test_chunks_follow_the_counter(spark):
    rng = random.Random(6)
    vocabulary = counters.UnigramCounter(spark.createDataFrame(VOCABULARY, "piece string, score double"))
    heuristic = counters.HeuristicCounter._size
    plain = {
        "heuristic": lambda t: heuristic(sum(c in "日本" for c in t), sum(c not in "日本" for c in t)),
        "words": lambda t: len(t.split()),
        "unigram:vocabulary": counters.unigram_reader(dict(VOCABULARY)),
    }
    pages = [made_blocks(rng, n) for n in (0, 1, 2, 5, 30)]
    seen = set()
    for counter in (counters.HEURISTIC, counters.WORDS, vocabulary):
        for blocks in pages:
            got = chunking.chunk_structural(page(spark, blocks), 24, 6, 9, counter).orderBy("ordinal").collect()
            want = plain_structural(blocks, 24, 6, 9, plain[counter.name])
            assert [(list(r.section_path), r.text, r.token_count) for r in got] == want, (counter.name, blocks)
            seen.add((counter.name, len(got)))
    assert len({n for _, n in seen}) > 5


def test_unigram_takes_the_likeliest_segmentation():
    table, rng = dict(VOCABULARY), random.Random(1)
    floor = min(table.values()) - counters.UNKNOWN
    count = counters.unigram_reader(table)
    for _ in range(200):
        word = "".join(rng.choices("thisenab?", k=rng.randint(1, 8)))
        text, scored = counters.MARK + word, []
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(text)), k) for k in range(len(text))):
            parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)), strict=True)]
            score = sum(table.get(p, floor if len(p) == 1 else -math.inf) for p in parts)
            scored.append((score, len(parts)))
        best = max(s for s, _ in scored)
        assert count(word) in {n for s, n in scored if s > best - 1e-9}
    assert count("") == 0 and count(" \n") == 0 and count("a b") == count("a") + count("b")


def test_counters_of_files_and_models(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    sizes = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        counter = counters.FileCounter(public_tokenizers.path(name))
        sizes.append(page(spark, [(["A"], LONG)]).select(counter.sizes(F.transform("blocks", lambda b: b["text"]))).first()[0][0])
    assert all(200 < n < 700 for n in sizes)
    with pytest.raises(ValueError, match="larger"):
        big = spark.range(1).select(F.repeat(F.lit("x"), 70 << 20).alias("piece"), F.lit(0.0).alias("score"))
        counters.UnigramCounter(big)


def test_long_pages_take_linear_time(spark):
    """A page of 100,000 lines, of which each third is a heading, parsed and cut within seconds."""
    lines = "\n".join(f"# Head {i}\nSome words of line {i}.\nAnd more of them. Then the end." for i in range(34_000))
    docs = spark.createDataFrame([("docs/a.md", "en", "T", "u", lines, "s")], "parallel_id string, lang string, title string, url string, body string, commit_sha string")
    began = time.time()
    n, tokens = chunking.chunk_documents(docs, target=128, overlap=32, least=16).agg(F.count("*"), F.sum("token_count")).first()
    assert n == 17_000 and tokens > 400_000 and time.time() - began < 30


def test_outline_of_lines():
    # heading 1, text, heading 2 without a title, fence, heading inside it, fence, text
    assert markdown.outline([11, 0, 22, 1, 11, 2, 1, 0]) == [{"first": 1, "n": 1, "path": [0]}, {"first": 3, "n": 5, "path": [0]}]
    assert markdown.outline([]) == [] and markdown.outline([11]) == []
