"""The named queries over the driver's tables, each a composition of the engine's operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine, EngineConfig, SparseRetriever
from ..functions import markdown, text
from ..operators import blockmax, bm25, chunking, correction, counters, dense, evaluation, prompts, providers, verification
from ..sources import reports, tables, traces
from ..streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP_K = 10


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; long ones are spread over all cores where the file has few row groups."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return tables.spread(df) if {"text", "html", "embedding"} & set(columns) else df


# ---- text primitives -------------------------------------------------------------------


@query
def script_of_documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query
def token_count_heuristic(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.token_count(F.col("text")).alias("token_count"))


@query
def sentence_split(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("idx", "sentence"))


@query
def word_terms(spark, d):
    terms = table(spark, d, "documents", "doc_id", "text").select(F.explode(text.words(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query
def char_bigram_terms(spark, d):
    terms = table(spark, d, "documents", "doc_id", "text").select(F.explode(text.char_bigrams(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query
def segment_dispatch(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", text.query_lang(F.col("text")).alias("segmenter"), F.size(text.segments(F.col("text"), text.query_lang(F.col("text")))).alias("n_terms"))


@query
def clean_inline_pages(spark, d):
    return table(spark, d, "pages", "page_id", "html").select("page_id", text.strip(markdown.clean_inline(F.col("html"))).alias("cleaned"))


@query
def page_sections(spark, d):
    """Blocks of web pages under their headings."""
    blocks = table(spark, d, "pages", "page_id", "html").select("page_id", F.posexplode(markdown.html_blocks(F.col("html"))).alias("idx", "b"))
    return blocks.select("page_id", "idx", F.array_join("b.section_path", text.TRAIL).alias("path"), F.col("b.text").alias("text"))


@query
def page_titles(spark, d):
    html = F.col("html")
    title = text.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = text.strip(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return table(spark, d, "pages", "page_id", "html").select("page_id", title.alias("title"), heading.alias("heading"))


def _located(spark, d) -> DataFrame:
    lang, number = (F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/]+)/([0-9]+)", i) for i in (1, 2))
    return table(spark, d, "pages", "page_id", "url").select("page_id", lang.alias("lang"), number.alias("number"))


@query
def url_to_parallel_id(spark, d):
    return _located(spark, d).select("page_id", "lang", F.concat(F.lit("docs/"), "number", F.lit(".md")).alias("parallel_id"))


@query
def path_keep_filter(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("concepts", "reference", "contribute", "test", "glossary", "tasks/includes", "setup")]), (F.col("page_id") % 7 + 1).cast("int"))
    leaf = F.when(F.col("page_id") % 5 == 0, "_index.md").when(F.col("page_id") % 11 == 0, "page.html").otherwise(F.concat("number", F.lit(".md")))
    paths = _located(spark, d).withColumn("rel", F.concat(F.lit("docs/"), kind, F.lit("/"), leaf))
    return paths.select("page_id", "rel", text.keep_path(F.col("rel")).alias("kept"), text.keep_path(F.col("rel"), True).alias("kept_with_reference"))


@query
def corpus_stats_parallel(spark, d):
    pages = _located(spark, d).withColumn("parallel_id", (F.col("number").cast("long") % 50).cast("string"))
    return chunking.corpus_stats(pages.withColumn("lang", F.when(F.col("lang") == "en", "en").otherwise("ja")), "sha")


@query
def chunk_ids(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang")
    doc = F.concat_ws(":", "lang", F.col("doc_id").cast("string"))
    cid = text.make_chunk_id(doc, F.lit("structural"), F.lit(0))
    return docs.select("doc_id", cid.alias("chunk_id"), text.point_id(cid).alias("point_id"))


@query
def heading_trails(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    return docs.select("doc_id", F.md5(text.for_embedding(F.col("source"), F.array("lang"), F.col("text")).cast("binary")).alias("embedded_md5"))


# ---- chunking --------------------------------------------------------------------------


def _pages(spark, d) -> DataFrame:
    """Documents as pages: the lines of a text are its blocks, the first two words of a line its section."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    blocks = F.transform(lines, lambda x: F.struct(F.array(F.lit("page"), F.substring(x, 1, 1)).alias("section_path"), x.alias("text")))
    return docs.select(
        F.col("doc_id").cast("string").alias("parallel_id"), "lang", F.col("source").alias("title"), F.concat(F.lit("doc://"), "doc_id").alias("url"),
        F.lit("sha").alias("commit_sha"), blocks.alias("blocks"),
    )


def _told(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_id", F.array_join("section_path", "/").alias("path"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "token_count", "char_count", "ordinal")


@query
def fixed_chunks(spark, d):
    return _told(chunking.chunk_fixed(_pages(spark, d), 128, 32, 16))


@query
def structural_chunks(spark, d):
    return _told(chunking.chunk_structural(_pages(spark, d), 128, 32, 16))


@query
def structural_chunks_by_words(spark, d):
    """The same windows under a counter that reads the texts: one token a word."""
    return _told(chunking.chunk_structural(_pages(spark, d), 90, 20, 12, counters.WORDS))


@query
def chunk_manifest(spark, d):
    pages = _pages(spark, d)
    m = chunking.manifest(pages, chunking.chunk_structural(pages), strategy="structural", tokenizer="heuristic")
    return m.select("pages", "chunks_total", "documents_yielding_no_chunks", F.to_json("chunks_by_lang").alias("by_lang"), F.to_json("mean_tokens_by_lang").alias("mean_tokens"), "strategy", "tokenizer")


# ---- sparse retrieval ------------------------------------------------------------------


def _index(spark, d) -> bm25.Bm25Index:
    """The application's stored index over ``documents``: made by the first query that reads it, and anew where the table has changed."""
    source = f"{d}/documents.parquet"
    state = tables.source_state(spark, source) | {"changed": tables.changed_at(spark, source)}
    at = f"{tables.scratch_dir(spark)}/bm25-{spark.sparkContext.applicationId}-{hashlib.sha256(state['source'].encode()).hexdigest()[:16]}"
    return tables.current_index(spark, at, state, lambda: _built(spark, d))


def _built(spark, d) -> bm25.Bm25Index:
    """The index over ``documents`` as it is made: texts are cut and counted once."""
    return bm25.index_of(tables.kept(bm25.counted(table(spark, d, "documents", "doc_id", "text", "lang"), id_col="doc_id")))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hits(h: DataFrame) -> DataFrame:
    return h.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def postings(spark, d):
    return _index(spark, d).postings.select(F.col("chunk_id").alias("doc_id"), "term", "tf")


@query
def doc_lengths_avgdl(spark, d):
    ix = _index(spark, d)
    return ix.doc_stats.crossJoin(F.broadcast(ix.corpus_stats)).select(F.col("chunk_id").alias("doc_id"), "dl", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def idf_epsilon_floor(spark, d):
    return _index(spark, d).term_idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_candidates(spark, d):
    return bm25.candidates(_index(spark, d), bm25.query_terms(_asked(spark, d))).groupBy("query_id").agg(F.count("*").alias("n_candidates"))


@query
def bm25_topk(spark, d):
    return _hits(bm25.search(_index(spark, d), _asked(spark, d), TOP_K))


@query
def bm25_block_topk(spark, d):
    """The same from postings in blocks, of which only those are read that can hold one of the best."""
    return _hits(_block_search(spark, d).hits)


def _block_search(spark, d) -> blockmax.BlockSearch:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    index = blockmax.block_index(tables.kept(blockmax.blocked(docs, id_col="doc_id")), tables.kept)
    return blockmax.block_search(index, _asked(spark, d), tables.kept, TOP_K)


@query
def bm25_topk_lang_filtered(spark, d):
    asked = _asked(spark, d)
    lang = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    return _hits(bm25.search(_index(spark, d), asked, TOP_K, lang))


@query
def bm25_duplicate_query_terms(spark, d):
    asked = _asked(spark, d).withColumn("query", F.concat_ws(" ", "query", F.regexp_extract("query", r"^\S+", 0)))
    return _hits(bm25.search(_index(spark, d), asked, TOP_K))


@query
def bm25_topk_filled(spark, d):
    """With places filled by chunks that share no term: one-word queries of which few hit."""
    asked = _asked(spark, d).withColumn("query", F.regexp_extract("query", r"(\S+)\s*$", 1))
    return _hits(bm25.search(_index(spark, d), asked, TOP_K, fill_zero_scores=True))


# ---- dense retrieval, fusion, reranking ------------------------------------------------


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("wanted"))
    return dense.require_dim(v, "embedding", 64), q


def _near(h: DataFrame) -> DataFrame:
    # ids as numbers again; the order of ties is by number
    return h.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@query
def dense_cosine_topk(spark, d):
    v, q = _vectors(spark, d)
    return _near(dense.dense_search(v, q.drop("wanted"), TOP_K, "vec_id"))


@query
def dense_cosine_topk_filtered(spark, d):
    v, q = _vectors(spark, d)
    return _near(dense.dense_search(v, q, TOP_K, "vec_id", filter_col="label"))


def _coverage(index: bm25.Bm25Index, asked: DataFrame, k: int) -> DataFrame:
    """Documents ranked by the number of distinct query terms they hold."""
    return bm25.top_k(bm25.coverage(index, bm25.query_terms(asked)), k)


@query
def rrf_hybrid_topk(spark, d):
    index, asked = _index(spark, d), _asked(spark, d)
    return _hits(dense.fuse(bm25.search(index, asked, dense.FUSE_FETCH), _coverage(index, asked, dense.FUSE_FETCH), TOP_K))


def _cover(query: str, body: str) -> Column:
    q, t = F.array_distinct(text.words(F.col(query))), F.array_distinct(text.words(F.col(body)))
    return F.try_divide(F.size(F.array_intersect(q, t)), F.size(q))


@query
def rerank_two_phase(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = tables.kept(bm25.search(_index(spark, d), _asked(spark, d), dense.RERANK_FETCH))
    return _hits(dense.rerank(hits, _asked(spark, d), docs, _cover("query", "text"), 5))


@query
def payload_join(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source").withColumnRenamed("doc_id", "chunk_id")
    return dense.with_payload(tables.kept(bm25.search(_index(spark, d), _asked(spark, d), 3)), docs).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), "lang", "source")


# ---- evaluation ------------------------------------------------------------------------


def _gold(spark, d, index: bm25.Bm25Index | None = None) -> DataFrame:
    """Benchmark items as gold: relevant are the documents that hold the passage, found among those that hold all its words."""
    asked = _asked(spark, d)
    at = index or _index(spark, d)
    terms = bm25.query_terms(asked)
    # a document that holds all words holds the least frequent one, whose postings are few
    rare = bm25.bounded(terms).join(at.term_idf.select("term", "df"), "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    words = terms.groupBy("query_id").agg(F.collect_list("term").alias("words")).join(asked, "query_id")
    by = at.postings.select("term", "chunk_id").join(bm25.bounded(rare), "term").groupBy("chunk_id").agg(F.collect_list("query_id").alias("ids"))
    docs = table(spark, d, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "chunk_id")
    met = tables.kept(by).join(docs, "chunk_id").select("chunk_id", "text", "lang", F.explode("ids").alias("query_id"))
    held = met.join(bm25.bounded(words), "query_id").where(F.contains("text", "query"))
    held = held.where(F.size(F.array_except("words", at.cut(F.col("text"), F.col("lang")))) == 0)
    rel = held.groupBy("query_id").agg(F.sort_array(F.collect_set(F.col("chunk_id"))).alias("relevant"))
    lang = F.when(F.col("query_id") % 2 == 0, "en").otherwise("ja")
    return tables.kept(asked.join(rel, "query_id", "left").select("query_id", lang.alias("lang"), F.coalesce("relevant", F.array().cast("array<bigint>")).alias("relevant")))


def _ranked_docs(hits: DataFrame) -> DataFrame:
    return evaluation.page_ranking(hits.select("query_id", F.col("chunk_id").alias("page_id"), "rank"))


@query
def page_dedupe_ranking(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_id"))
    return evaluation.page_ranking(tables.kept(bm25.search(_index(spark, d), _asked(spark, d), TOP_K)).join(docs, "chunk_id"))


def _bm25_items(spark, d) -> DataFrame:
    return _arms(spark, d)[0]


def _arms(spark, d) -> tuple[DataFrame, DataFrame]:
    """Item metrics of BM25 and of term coverage against one gold table."""
    index, asked = _index(spark, d), _asked(spark, d)
    gold = _gold(spark, d, index)
    return tuple(evaluation.item_metrics(gold, _ranked_docs(h)) for h in (bm25.search(index, asked, TOP_K), _coverage(index, asked, TOP_K)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def item_metrics(spark, d):
    return _rounded(_bm25_items(spark, d))


@query
def recall_mrr_ndcg(spark, d):
    return _rounded(evaluation.report(_bm25_items(spark, d)))


@query
def ablation_table(spark, d):
    found, cover = _arms(spark, d)
    return _rounded(evaluation.ablation({"bm25": evaluation.report(found), "coverage": evaluation.report(cover)}))


@query
def backend_parity(spark, d):
    """BM25 against term coverage."""
    index, asked = _index(spark, d), _asked(spark, d)
    return evaluation.parity(_ranked_docs(bm25.search(index, asked, TOP_K)), _ranked_docs(_coverage(index, asked, TOP_K)))


@query
def stored_backend_parity(spark, d):
    """The index in the plan, with places filled, against the one stored on disk: first pages, recall and reciprocal rank."""
    index = _built(spark, d)
    path = f"{tables.scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    tables.save_index(index, path, {"source": d})
    asked, gold = _asked(spark, d), _gold(spark, d, index)
    sides = (index, True), (tables.load_index(spark, path), False)
    ranked = [tables.kept(_ranked_docs(bm25.search(x, asked, TOP_K, fill_zero_scores=fill))) for x, fill in sides]
    a, b = (evaluation.report(evaluation.item_metrics(gold, r)) for r in ranked)
    return evaluation.parity(*ranked).crossJoin(F.broadcast(evaluation.deltas(a, b)))


@query
def stored_index_topk(spark, d):
    """A search of an index that was saved and loaded again."""
    path = f"{tables.scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    tables.save_index(_built(spark, d), path, {"source": d})
    return _hits(bm25.search(tables.load_index(spark, path), _asked(spark, d), TOP_K))


@query
def stored_index_versions(spark, d):
    """An index built anew after its source has grown: what each version holds, which one is current, and what a reader of the first still sees."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    path = f"{tables.scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    parts = docs.where("doc_id % 2 = 0"), docs
    numbers = [tables.save_index(bm25.index_of(tables.kept(bm25.counted(x, id_col="doc_id"))), path, {"part": i}) for i, x in enumerate(parts)]
    rows = [
        tables.load_index(spark, path, version=n).corpus_stats.select(F.lit(n).cast("long").alias("version"), "n_docs", F.round("avgdl", 6).alias("avgdl"), F.lit(tables.is_current(spark, path, {"part": i})).alias("is_current"))
        for i, n in enumerate(numbers)
    ]
    return rows[0].union(rows[1])


@query
def index_count_name(spark, d):
    index = _index(spark, d)
    return index.doc_stats.groupBy("lang").agg(F.count("*").alias("n_chunks")).withColumns({"n_index": F.lit(index.count()), "name": F.lit(index.name)})


@query
def query_operator_words(spark, d):
    """Operator words and quotes of a query are plain terms, marks alone are none."""
    asked = _asked(spark, d).withColumn("query", F.concat(F.lit('NOT "quoted" OR * ( - '), "query", F.lit(' AND "" NEAR not')))
    return bm25.query_terms(asked)


@query
def vector_upsert(spark, d):
    """Two upserts into one collection: later texts replace those of the same id, the others stay."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    cid = text.make_chunk_id(F.concat_ws(":", "lang", F.col("doc_id").cast("string")), F.lit("fixed"), F.lit(0))
    chunks = docs.select(cid.alias("chunk_id"), F.col("source").alias("title"), F.array("lang").alias("section_path"), "text", "doc_id")
    path = f"{tables.scratch_dir(spark)}/vectors-{uuid.uuid4().hex}"
    tables.upsert_vectors(chunks.where("doc_id % 2 = 0"), providers.FakeEmbedder(), path)
    got = tables.upsert_vectors(chunks.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))), providers.FakeEmbedder(), path)
    return got.select("doc_id", "chunk_id", "point_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("embedding").alias("dim"))


@query
def vector_collection_state(spark, d):
    """A collection's marker and size after an upsert that changes some of it and one that changes nothing."""
    v = table(spark, d, "documents", "doc_id", "lang", "source")
    chunks = v.select(text.make_chunk_id(F.col("lang"), F.lit("fixed"), F.col("doc_id")).alias("chunk_id"), F.col("source").alias("title"), F.array("lang").alias("section_path"), F.col("source").alias("text"), "lang")
    path, embedder = f"{tables.scratch_dir(spark)}/vectors-{uuid.uuid4().hex}", providers.FakeEmbedder(32)
    tables.upsert_vectors(chunks, embedder, path, 16)
    tables.upsert_vectors(chunks.where("lang = 'en'").withColumn("text", F.lit("new")), embedder, path)
    got, state = tables.upsert_vectors(chunks.where("false"), embedder, path), tables.collection_state(spark, path)
    dim = dense.require_dim(got, "embedding", embedder.dim).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "new").alias("n_new"), F.max(F.size("embedding")).alias("dim"))
    return dim.withColumns({"embedder": F.lit(state["embedder"]), "buckets": F.lit(state["buckets"])})


@query
def chunk_roundtrip(spark, d):
    """Chunks written as JSON lines and read under the schema."""
    path = f"{tables.scratch_dir(spark)}/chunks-{uuid.uuid4().hex}"
    tables.write_lines(chunking.chunk_fixed(_pages(spark, d), 128, 32, 16), path)
    return _told(tables.read_chunks(spark, path))


# ---- page format -----------------------------------------------------------------------


@query
def shortcodes_rendered(spark, d):
    """Every kind of shortcode, around the words of a document's row."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    raw = F.concat(
        F.lit('A {{< glossary_tooltip text="'), "source", F.lit('" term_id="a-b_c" >}} and {{< glossary_tooltip term_id="'), "lang", F.lit('-x_y" >}}; {{< glossary_definition prepend="'), "source",
        F.lit('" term_id="q" length="all" >}}. {{< feature-state state="beta" for_k8s_version="v1.'), F.col("doc_id").cast("string"), F.lit('" >}} {{% heading "'), "lang",
        F.lit('" %}} {{< note >}}kept{{< /note >}} {{< feature-state feature_gate_name="G" >}}<!-- gone -->[link](http://x)![image](y) <b>bold</b>'),
    )
    return docs.select("doc_id", markdown.clean_inline(raw).alias("shown"))


@query
def front_matter(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    quote = F.when(F.col("doc_id") % 3 == 0, '"').when(F.col("doc_id") % 3 == 1, "'").otherwise("")
    raw = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("---\nweight: 3\ntitle: "), quote, "source", F.lit(" "), "lang", quote, F.lit("  \nlinkTitle: other\n---\n"), "text"))
    body = F.md5(markdown.front_matter_body(raw).cast("binary")).alias("body_md5")
    return docs.select("doc_id", markdown.front_matter_title(raw).alias("title"), body)


@query
def front_matter_map(spark, d):
    """Headers with quotes, lists, a folded text and nested keys; each fifth is malformed and gives no key."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    raw = F.concat(
        F.lit("---\n# a header\nweight: "), F.col("doc_id").cast("string"), F.lit("  # order\ntitle: 'it''s "), "source", F.lit(' "'), "lang", F.lit("\"'\ntags: ["), "lang", F.lit(', "a, b", '), "source",
        F.lit("]\nsummary: >\n  about "), "source", F.lit("\n  and more\n\n  end\nowner:\n  name: "), "lang", F.lit(" team\naliases:\n- /"), F.col("doc_id").cast("string"), F.lit("\n- /"), "source",
        F.when(F.col("doc_id") % 5 == 0, "\nbroken: [unclosed").otherwise(""), F.lit("\n---\n"), "text",
    )
    page = docs.select("doc_id", markdown.front_matter(raw).alias("m"), F.md5(markdown.front_matter_body(raw).cast("binary")).alias("body_md5"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return page.select("doc_id", (F.size("m") > 0).alias("has_map"), *[at(k).alias(k) for k in ("weight", "title", "tags", "summary")], at("owner.name").alias("owner"), at("aliases").alias("aliases"), "body_md5")


@query
def markdown_blocks(spark, d):
    """Headings, fences and empty sections of a page made of a document's row."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    raw = F.concat(
        F.lit("lead of "), "source", F.lit("\n# One {#one}\nfirst "), "lang", F.lit("\n\n\n\nmore\n## Two ##\n```\n# no heading\n```\n### Empty\n## "), "source", F.lit("\ntail "), F.col("doc_id").cast("string"), F.lit("\n# Last\n"),
    )
    blocks = docs.select("doc_id", F.posexplode(markdown.blocks(raw)).alias("idx", "b"))
    return blocks.select("doc_id", "idx", F.array_join("b.section_path", "/").alias("path"), F.col("b.text").alias("text"))


@query
def common_prefixes(spark, d):
    """Prefixes that the addresses of two neighbouring pages share."""
    p = table(spark, d, "pages", "page_id", "url").select("page_id", F.split("url", "[/.-]").alias("parts"))
    other = p.select((F.col("page_id") - 1).alias("page_id"), F.col("parts").alias("next"))
    return p.join(other, "page_id").select("page_id", F.array_join(text.common_prefix(F.col("parts"), F.col("next")), "/").alias("shared"))


@query
def eval_gate(spark, d):
    r5 = evaluation.report(_bm25_items(spark, d)).where("lang is null").select(F.lit("bm25_recall_at_5").alias("metric"), F.col("recall_at_5").alias("value"))
    acc = evaluation.label_metrics(_matrix(spark, d)).limit(1).select(F.lit("lexical_faithfulness_accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return _rounded(evaluation.gate(r5.union(acc)))


@query
def gold_validation(spark, d):
    """Benchmark items as gold with planted faults: items 0 to 2 doubled, every seventh said to be answerable."""
    g = _gold(spark, d).select(
        F.col("query_id").cast("string").alias("id"), F.col("relevant").cast("array<string>").alias("relevant_parallel_ids"),
        ((F.size("relevant") > 0) | (F.col("query_id") % 7 == 0)).alias("answerable"),
    )
    pages = table(spark, d, "documents", "doc_id").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("parallel_id"))
    return evaluation.gold_problems(g.union(g.where("id in ('0', '1', '2')")), pages).distinct()


def _matrix(spark, d) -> DataFrame:
    """Label quality of documents against the guess that a text of at least a tenth of marks is poor."""
    docs = table(spark, d, "documents", "doc_id", "text")
    marks = F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]")) * 10 >= F.length("text")
    guess = F.when(marks, "unsupported").otherwise("supported")
    truth = table(spark, d, "labels", "doc_id", "quality").select("doc_id", F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("true_label"))
    return evaluation.confusion(docs.join(truth, "doc_id").select("true_label", guess.alias("predicted_label")))


@query
def confusion_matrix(spark, d):
    return _matrix(spark, d)


@query
def label_precision_recall(spark, d):
    return _rounded(evaluation.label_metrics(_matrix(spark, d)))


# ---- claims, verification, correction --------------------------------------------------


def _answers(spark, d) -> DataFrame:
    """Assistant turns with the user's last words before them as the question; a turn repeated in its conversation counts once."""
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.struct(-F.col("turn"), "text"))
    asked = c.withColumn("question", F.min(said).over(before)["text"])
    return asked.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "question", "text")


def _evidence(spark, d) -> DataFrame:
    """User turns of the answer's conversation, by turn; a turn repeated in it counts once."""
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    e = _answers(spark, d).select("answer_id", "conv_id").join(c, "conv_id")
    return e.groupBy("answer_id", "turn").agg(F.min("text").alias("evidence")).select("answer_id", F.col("turn").cast("int").alias("evidence_index"), "evidence")


def _claims(spark, d) -> DataFrame:
    return verification.sentence_claims(_answers(spark, d))


@query
def decompose_claims(spark, d):
    return _claims(spark, d)


@query
def claim_list_lines(spark, d):
    """Claims from a model's list: here a turn's sentences, one on a line with a bullet."""
    listed = _answers(spark, d).withColumn("reply", F.array_join(F.transform(text.sentences(F.col("text")), lambda s: F.concat(F.lit("- "), s)), "\n"))
    return verification.line_claims(listed)


def _verdicts(spark, d) -> DataFrame:
    return verification.lexical(_claims(spark, d), _evidence(spark, d))


@query
def lexical_verify_claims(spark, d):
    return _rounded(_verdicts(spark, d))


@query
def faithfulness_rate(spark, d):
    return _rounded(verification.faithfulness(_verdicts(spark, d), _answers(spark, d)))


@query
def embedding_verify(spark, d):
    """Vectors divisible by 50 as claims, the ten before each as its evidence."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    claims = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("answer_id"), F.lit(0).alias("claim_index"), F.col("vec_id").cast("string").alias("claim"), F.col("embedding").alias("claim_vec"))
    owner = F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct((F.col("vec_id") + i).alias("a"), (10 - i).cast("int").alias("e"))), lambda x: x["a"] % 50 == 0))
    evidence = v.select(owner.alias("x"), F.col("embedding").alias("evidence_vec")).select(F.col("x.a").alias("answer_id"), F.col("x.e").alias("evidence_index"), "evidence_vec")
    return _rounded(verification.embedding(claims, evidence))


@query
def nli_decision_rule(spark, d):
    """The rule over probabilities that the events' values stand in for: three to a claim."""
    e = table(spark, d, "events", "event_id", "value")
    claims = e.where("event_id % 3 = 0").select((F.col("event_id") / 3).cast("long").alias("answer_id"), F.lit(0).alias("claim_index"), F.col("event_id").cast("string").alias("claim"))
    unit = lambda c: F.pmod(F.abs(F.round(c * 1000).cast("long")), F.lit(1001)) / 1000
    p = e.select(F.expr("event_id div 3").alias("answer_id"), F.lit(0).alias("claim_index"), (F.col("event_id") % 3).cast("int").alias("evidence_index"),
                 unit(F.col("value")).alias("entailment"), (1 - unit(F.col("value"))).alias("contradiction"))
    return _rounded(verification.nli(claims, p))


@query
def judge_label_parse(spark, d):
    replies = F.element_at(F.array(*[F.lit(x) for x in ("Supported.", " unsupported", "CONTRADICTED by [1]", "[ECHO]", "It is not supported", "UNSUPPORTED, not SUPPORTED")]), (F.col("conv_id") % 6 + 1).cast("int"))
    return table(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", text.judge_label(replies).alias("label"))


def _retrieve(spark, d):
    """Search of the benchmark's passages, with their texts."""
    items = table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("chunk_id"), "text", F.lit("en").alias("lang"))
    index = bm25.build_index(items)
    return lambda queries: dense.with_payload(bm25.search(index, queries, correction.RETRY_TOP_K), items).select("query_id", "rank", "text")


def _decisions(spark, d) -> DataFrame:
    verdicts = tables.kept(_verdicts(spark, d))
    return correction.decide(verdicts, correction.retry(verdicts, _retrieve(spark, d)))


@query
def correction_decisions(spark, d):
    return _rounded(_decisions(spark, d).drop("method", "final_method"))


@query
def corrected_answers(spark, d):
    """Decisions are written before answers are read, so that one plan does not hold the search and the questions."""
    decisions = tables.kept(_decisions(spark, d).select("answer_id", "claim_index", "claim", "action"))
    return correction.corrected(_answers(spark, d), decisions)


@query
def refusal_rates(spark, d):
    fixed = correction.corrected(_answers(spark, d), _decisions(spark, d))
    return _rounded(evaluation.refusal_rates(fixed.withColumn("answerable", F.col("answer_id") % 4 != 0)))


@query
def grounded_prompts(spark, d):
    """Prompts of the benchmark's passages as questions over their three best documents."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.array("lang").alias("section_path"), "text"
    )
    asked = _asked(spark, d).withColumnRenamed("query", "question")
    hits = dense.with_payload(tables.kept(bm25.search(_index(spark, d), _asked(spark, d), 3)), docs)
    p = prompts.build_prompts(asked, hits)
    return p.select("query_id", F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), prompts.echo(F.col("prompt")).alias("answer"))


@query
def asked_answers(spark, d):
    """Questions to corrected answers in one go: retrieved, answered by the echo, cut into claims, verified, looked up again, corrected."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("parallel_id"), "lang", F.col("source").alias("title"), F.array("lang").alias("section_path"), "text"
    )
    config = EngineConfig(retriever="sparse", sparse_backend="fts5", llm_provider=None, embedder_model=None)
    parts = providers.EchoProvider(), providers.get_verifier("lexical"), providers.get_decomposer("sentence", None)
    asked = _asked(spark, d).withColumnRenamed("query", "question")
    got = Engine(spark, config, docs, SparseRetriever(_index(spark, d), "fts5"), *parts).ask(asked, 3, write_trace=False)
    kept = F.size(F.filter("claims", lambda c: c["action"] != "struck"))
    return got.select("trace_id", "question", "answer_text", F.size("retrieved").alias("n_retrieved"), F.get("retrieved", F.lit(0))["chunk_id"].cast("string").alias("first_id"),
                      F.size("claims").alias("n_claims"), kept.alias("n_kept"), "final_text", "refused", "refusal_reason")


@query
def refusal_windows(spark, d):
    """Refusals in windows of ten minutes, from a log that a stream filled; half of the traces were sent twice."""
    at = f"{tables.scratch_dir(spark)}/traces-{uuid.uuid4().hex}"
    made = traces.from_turns(table(spark, d, "conversations", "conv_id", "turn", "role", "text"))
    odd = F.length("trace_id") % 2 == 1
    for part in (made.where(odd), made.where(~odd), made.where(odd)):
        traces.append(part, f"{at}/in")
        traces.sink(monitor.trace_stream(spark, f"{at}/in"), f"{at}/log").awaitTermination()
    rates = monitor.refusal_rates(traces.read_log(spark, f"{at}/log"))
    return rates.select(F.unix_timestamp("start").alias("start_s"), "n", "refused", F.round("refusal_rate", 6).alias("refusal_rate"))


@query
def report_deltas(spark, d):
    """Two runs of an evaluation in an appended history, and what changed between them."""
    (found, cover), path = _arms(spark, d), f"{tables.scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    reports.append(evaluation.report(found), path, "sparse", "2024-05-01T00:00:00Z")
    reports.append(evaluation.report(cover), path, "sparse", "2024-05-02T00:00:00Z")
    return _rounded(reports.deltas(reports.history(spark, path)).drop("name"))


@query
def trace_roundtrip(spark, d):
    return traces.parsed(traces.as_lines(traces.from_turns(table(spark, d, "conversations", "conv_id", "turn", "role", "text")))).select(
        "trace_id", "question", "refused", F.round("timestamp", 3).alias("timestamp"), F.size("claims").alias("n_claims"), F.round(F.col("latency_ms")["total"], 3).alias("total_ms")
    )


# ---- plug-ins without meaning, for plumbing --------------------------------------------


@query
def fake_embedder_vectors(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", providers.FakeEmbedder().embed_passages(F.col("text")).alias("embedding"))


@query
def fake_reranker_scores(spark, d):
    """The five best documents of each passage, ordered by the stand-in for a cross-encoder."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("chunk_id"), "text")
    hits, score = tables.kept(bm25.search(_index(spark, d), _asked(spark, d), 5)), providers.FakeReranker().score(F.col("query"), F.col("text"))
    return _hits(dense.rerank(hits, _asked(spark, d), docs, score, 5))


@query
def fake_verifier_verdicts(spark, d):
    return verification.fake(_claims(spark, d), _evidence(spark, d))
