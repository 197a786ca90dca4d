"""Chunking of parsed pages: fixed windows and heading-aware windows.

Sections, sentences and the joining of pieces are Column expressions; a counter measures
texts, by default from two numbers for each; with that one only arrays of numbers go to Python,
where small sections are carried and windows are cut over prefix sums.  Every step is linear in
the page.  A page stays in its row, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.text import common_prefix, let, make_chunk_id, sentences
from .counters import HEURISTIC

# fixed values: tokens of a chunk, of an overlap, and of the smallest chunk
TARGET, OVERLAP, LEAST = 512, 64, 32

_SECTIONS = "array<struct<section_path:array<string>,text:string>>"


def windows(sizes, target: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open windows of about ``target``, each starting so that it repeats about ``overlap`` of the last.

    A window holds as many units as fit, one at least, and each starts after the one before.
    """
    upto = [0, *accumulate(int(s) for s in sizes)]
    n, i, out = len(upto) - 1, 0, []
    while i < n:
        j = max(i + 1, bisect_right(upto, upto[i] + target) - 1)
        out.append((i, j))
        if j >= n:
            break
        back = bisect_right(upto, upto[j] - overlap, i + 1, j + 1) - 1
        i = j if overlap <= 0 or j == i + 1 else max(i + 1, back)
    return out


def _window_column(target: int, overlap: int):
    @F.pandas_udf("array<array<struct<i:int,j:int>>>")
    def cut(sizes: pd.Series, counts: pd.Series) -> pd.Series:
        def page(flat, lists):
            ends = [*accumulate(int(n) for n in lists)]
            return [[{"i": i, "j": j} for i, j in windows(flat[a:b], target, overlap)] for a, b in zip([0, *ends], ends, strict=False)]

        return pd.Series([page(s, n) for s, n in zip(sizes, counts, strict=True)], dtype=object)

    # else the optimiser would put it into the lambdas that read its result, where Python cannot run
    return cut.asNondeterministic()


def grouped_sections(blocks: Column) -> Column:
    """Consecutive blocks of one path as one section, texts joined by a blank line."""

    def of(b):
        at = lambda i: F.get(b, i)["section_path"]
        every = F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0)))
        starts = F.filter(every, lambda i: (F.size(b) > 0) & ((i == 0) | ~at(i).eqNullSafe(at(i - 1))))

        def section(s):
            def one(i, k):
                mine = F.slice(b, i + 1, F.coalesce(F.get(s, k + 1), F.size(b)) - i)
                return F.struct(at(i).alias("section_path"), F.array_join(F.transform(mine, lambda x: x["text"]), "\n\n").alias("text"))

            return F.transform(s, one)

        return let(starts, section)

    return let(blocks, of)


def _joined(sections: Column, group: Column) -> Column:
    """Sections ``group.first`` to ``group.last`` as one, under the path that all of them share."""
    mine = F.slice(sections, group["first"] + 1, group["last"] - group["first"] + 1)
    paths = F.transform(mine, lambda s: s["section_path"])
    shared = F.aggregate(paths, F.get(paths, F.lit(0)), common_prefix)
    return F.struct(shared.alias("section_path"), F.array_join(F.transform(mine, lambda s: s["text"]), "\n\n").alias("text"))


def _pieces(units: str, cut: str, paths: Column) -> Column:
    """Windows of each unit list as array<struct<section_path, text>>."""
    place = F.sequence(F.lit(1), F.size(units))

    def of(i):
        def piece(w):
            text = F.array_join(F.slice(F.element_at(units, i), w["i"] + 1, w["j"] - w["i"]), " ")
            return F.struct(paths(i, w).alias("section_path"), text.alias("text"))

        return F.transform(F.element_at(cut, i), piece)

    pieces = F.flatten(F.transform(place, of))
    return F.when(F.size(units) > 0, pieces).otherwise(F.array().cast(_SECTIONS))


def _cut(pages: DataFrame, counter, target: int, overlap: int) -> DataFrame:
    """``pages`` with the windows of each list in ``units``."""
    sized = pages.withColumn("sizes", counter.sizes(F.flatten("units"))).withColumn("counts", F.transform("units", F.size))
    return sized.withColumn("cut", _window_column(target, overlap)("sizes", "counts"))


def _sized(pieces: str, counter) -> Column:
    """The pieces with their sizes: array<struct<section_path, text, n>>."""
    sizes = counter.sizes(F.transform(pieces, lambda p: p["text"]))
    return F.zip_with(pieces, sizes, lambda p, n: F.struct(p["section_path"].alias("section_path"), p["text"].alias("text"), n.alias("n")))


def _chunks(pages: DataFrame, strategy: str) -> DataFrame:
    """One row for each element of ``pieces``, with ids and counts."""
    out = pages.select("*", F.posexplode("pieces").alias("ordinal", "piece"))
    doc_id = F.concat_ws(":", "lang", "parallel_id")
    return out.select(
        make_chunk_id(doc_id, F.lit(strategy), F.col("ordinal")).alias("chunk_id"), doc_id.alias("doc_id"), "parallel_id", "lang", "title",
        F.col("piece.section_path").alias("section_path"), F.col("piece.text").alias("text"), F.col("piece.n").alias("token_count"),
        F.length("piece.text").alias("char_count"), F.col("ordinal"), "url", F.lit(strategy).alias("strategy"), "commit_sha",
        F.create_map().cast("map<string,string>").alias("meta"),
    )


def chunk_fixed(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, counter=HEURISTIC) -> DataFrame:
    """Windows over all sentences of a page (documents with a ``blocks`` column), under the path of the first sentence."""
    flat = F.flatten(F.transform("blocks", lambda b: F.transform(sentences(b["text"]), lambda s: F.struct(b["section_path"].alias("section_path"), s.alias("text")))))
    got = pages.withColumn("flat", flat).withColumn("units", F.array(F.transform("flat", lambda s: s["text"])))
    got = _cut(got, counter, target, overlap)
    got = got.withColumn("pieces", _pieces("units", "cut", lambda i, w: F.element_at("flat", w["i"] + 1)["section_path"])).withColumn("pieces", _sized("pieces", counter))
    return _chunks(got.withColumn("pieces", F.filter("pieces", lambda p: p["n"] >= least)), "fixed")


def chunk_structural(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, counter=HEURISTIC) -> DataFrame:
    """Windows inside sections; small sections join the next, a small last one the last chunk.

    ``counter`` measures texts (see ``counters``): sections, sentences and pieces once each.
    """
    got = pages.withColumn("parts", grouped_sections(F.col("blocks")))
    got = got.withColumn("groups", counter.groups(F.transform("parts", lambda s: s["text"]), least))
    got = got.withColumn("sections", F.transform(F.filter("groups", lambda g: ~g["small"]), lambda g: _joined(F.col("parts"), g)))
    got = got.withColumn("scrap", F.transform(F.filter("groups", lambda g: g["small"]), lambda g: _joined(F.col("parts"), g)))
    got = _cut(got.withColumn("units", F.transform("sections", lambda s: sentences(s["text"]))), counter, target, overlap)
    got = got.withColumn("pieces", _pieces("units", "cut", lambda i, w: F.element_at("sections", i)["section_path"])).withColumn("pieces", _sized("pieces", counter))
    got = got.withColumn("pieces", F.filter("pieces", lambda p: p["n"] >= least))
    # a small last section, which at most one is, ends the last piece or is the only one
    last, scrap = F.try_element_at("pieces", F.lit(-1)), F.element_at("scrap", 1)
    merged = F.struct(common_prefix(last["section_path"], scrap["section_path"]).alias("section_path"), F.concat(last["text"], F.lit("\n\n"), scrap["text"]).alias("text"))
    ending = F.when(F.size("scrap") == 0, F.array().cast(_SECTIONS)).when(F.size("pieces") > 0, F.array(merged)).otherwise(F.col("scrap"))
    got = got.withColumn("ending", ending).withColumn("ending", _sized("ending", counter))
    kept = F.when(F.size("ending") > 0, F.slice("pieces", F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(0)))).otherwise(F.col("pieces"))
    return _chunks(got.withColumn("pieces", F.concat(kept, "ending")), "structural")


STRATEGIES = {"structural": chunk_structural, "fixed": chunk_fixed}


def parse_documents(docs: DataFrame) -> DataFrame:
    """Documents (parallel_id, lang, title, url, body, commit_sha) with their blocks."""
    return docs.withColumn("blocks", markdown.blocks(markdown.front_matter_body(F.col("body"))))


def chunk_documents(docs: DataFrame, strategy: str = "structural", **sizes) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](parse_documents(docs), **sizes)


def corpus_stats(docs: DataFrame, commit_sha: str = "") -> DataFrame:
    """Pages of each language and of both, in one aggregation over page ids."""
    seen = docs.groupBy("parallel_id").agg(F.bool_or(F.col("lang") == "en").alias("en"), F.bool_or(F.col("lang") == "ja").alias("ja"))
    count = lambda c: F.count_if(c).alias
    en, ja = F.col("en"), F.col("ja")
    return seen.agg(count(en)("en_pages"), count(ja)("ja_pages"), count(en & ja)("parallel_pages"), count(en & ~ja)("en_only_pages"), F.lit(commit_sha).alias("commit_sha"))


def manifest(docs: DataFrame, chunks: DataFrame, **settings) -> DataFrame:
    """One row that describes a chunk table: counts, means by language and pages without a chunk."""
    by = chunks.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("token_count"), 1).alias("mean"))
    maps = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_total"),
                  F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("chunks_by_lang"),
                  F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "mean")))).alias("mean_tokens_by_lang"))
    without = docs.join(chunks.select("lang", "parallel_id").distinct(), ["lang", "parallel_id"], "left_anti").agg(F.count("*").alias("documents_yielding_no_chunks"))
    pages = docs.agg(F.count("*").alias("pages"))
    return pages.crossJoin(maps).crossJoin(without).select("*", *[F.lit(v).alias(k) for k, v in settings.items()])
