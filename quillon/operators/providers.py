"""Plug-ins: embedders, rerankers, language models, token counters, and their factories.

A plug-in gives Column expressions, so that a whole frame is handled at once.  The real
models are reached through libraries that may be missing; a factory then fails, or falls
back to a stand-in with a warning where that is allowed.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import segments
from . import prompts, verification
from .counters import HeuristicCounter, ModelCounter

# fixed values: model names and text prefixes
EMBEDDER, QUERY_PREFIX, PASSAGE_PREFIX = "intfloat/multilingual-e5-large", "query: ", "passage: "
RERANKER = "BAAI/bge-reranker-v2-m3"
NLI_MODEL = "MoritzLaurer/mDeBERTa-v3-base-xnli-multilingual-nli-2mil7"
LLM_MODEL = "llama-3.3-70b-versatile"


class Embedder(Protocol):
    name: str
    dim: int

    def embed_query(self, text: Column) -> Column: ...

    def embed_passages(self, text: Column) -> Column: ...


class Reranker(Protocol):
    name: str

    def score(self, query: Column, text: Column) -> Column: ...


class LLMProvider(Protocol):
    name: str

    def generate(self, prompt: Column, max_tokens: int = 1024) -> Column: ...


class TokenCounter(Protocol):
    name: str

    def sizes(self, texts: Column) -> Column: ...

    def groups(self, texts: Column, least: int) -> Column: ...


class Retriever(Protocol):
    """Queries (query_id, query) to hits (query_id, rank, chunk_id, score)."""

    name: str

    def search(self, queries: DataFrame, top_k: int = 5, lang_of: DataFrame | None = None) -> DataFrame: ...

    def count(self) -> int: ...


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


@lru_cache(maxsize=1 << 18)
def _place(gram: str, dim: int) -> int:
    return _hash64(gram) % dim


class FakeEmbedder:
    """Hashed character n-grams of unit length: the same text gives the same vector, meaning plays no part."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"fake:{dim}"

    def _column(self, text: Column, salt: str) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            def one(t):
                t, v = (t or "").strip().lower(), [0.0] * dim
                for size in (3, 4, 5):
                    for i in range(len(t) - size + 1):
                        v[_place(f"{salt}:{t[i : i + size]}", dim)] += 1.0
                norm = sum(x * x for x in v) ** 0.5
                return [x / norm for x in v] if norm else v

            return texts.map(one)

        return embed(text)

    def embed_query(self, text: Column) -> Column:
        return self._column(text, "q")

    def embed_passages(self, text: Column) -> Column:
        return self._column(text, "p")


class ModelEmbedder:
    """A sentence-transformers model, loaded once in each worker; vectors of unit length."""

    def __init__(self, model: str = EMBEDDER):
        import sentence_transformers

        self.model, self.name = model, f"model:{model}"
        self.dim = sentence_transformers.SentenceTransformer(model).get_sentence_embedding_dimension()

    def _column(self, text: Column, prefix: str) -> Column:
        model = self.model

        @F.pandas_udf("array<double>")
        def embed(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":  # noqa: F821, UP037
            import sentence_transformers

            loaded = sentence_transformers.SentenceTransformer(model)
            for texts in batches:
                yield pd.Series(list(loaded.encode([prefix + t for t in texts], normalize_embeddings=True)))

        return embed(text)

    def embed_query(self, text: Column) -> Column:
        return self._column(text, QUERY_PREFIX)

    def embed_passages(self, text: Column) -> Column:
        return self._column(text, PASSAGE_PREFIX)


class FakeReranker:
    name = "fake"

    def score(self, query: Column, text: Column) -> Column:
        return verification.hash_unit(F.concat(query, F.lit(":"), text))


class ModelReranker:
    """A cross-encoder over (query, text) pairs, loaded once in each worker."""

    def __init__(self, model: str = RERANKER):
        import sentence_transformers

        sentence_transformers.CrossEncoder(model)
        self.model, self.name = model, f"model:{model}"

    def score(self, query: Column, text: Column) -> Column:
        model = self.model

        @F.pandas_udf("double")
        def rate(batches: "Iterator[tuple[pd.Series, pd.Series]]") -> "Iterator[pd.Series]":  # noqa: F821, UP037
            import sentence_transformers

            loaded = sentence_transformers.CrossEncoder(model)
            for q, t in batches:
                yield pd.Series(loaded.predict(list(zip(q, t, strict=True))))

        return rate(query, text)


class EchoProvider:
    name = "echo"

    def generate(self, prompt: Column, max_tokens: int = 1024) -> Column:
        return prompts.echo(prompt)


class ChatProvider:
    """Chat completions over HTTPS by the client library of the service; needs its key."""

    def __init__(self, model: str = LLM_MODEL, key: str | None = None):
        import groq

        self.model, self.key, self.name = model, key, f"groq:{model}"
        groq.Groq(api_key=key)

    def generate(self, prompt: Column, max_tokens: int = 1024) -> Column:
        model, key = self.model, self.key

        @F.pandas_udf("string")
        def ask(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":  # noqa: F821, UP037
            import groq

            client = groq.Groq(api_key=key)
            for texts in batches:
                yield texts.map(
                    lambda p: client.chat.completions.create(model=model, messages=[{"role": "user", "content": p}], max_tokens=max_tokens, temperature=0.0).choices[0].message.content or ""
                )

        return ask(prompt)


def _load(make: Callable, fallback: Callable, what: str, allow_fallback: bool):
    try:
        return make()
    except Exception as why:
        if not allow_fallback:
            raise RuntimeError(f"the {what} cannot be loaded and no fallback is allowed: {why}") from why
        warnings.warn(f"{what} cannot be loaded ({type(why).__name__}); its stand-in's results must not be reported", RuntimeWarning, stacklevel=3)
        return fallback()


def get_embedder(model: str | None = EMBEDDER, allow_fallback: bool = False) -> Embedder:
    """The embedder of that name; none and ``fake:<dim>`` name the stand-in."""
    if model and re.fullmatch("fake:[0-9]+", model):
        return FakeEmbedder(int(model[5:]))
    return FakeEmbedder() if model is None else _load(lambda: ModelEmbedder(model), FakeEmbedder, "embedder", allow_fallback)


def get_reranker(model: str | None = RERANKER, allow_fallback: bool = False) -> Reranker:
    return FakeReranker() if model is None else _load(lambda: ModelReranker(model), FakeReranker, "reranker", allow_fallback)


def get_llm(provider: str | None = "groq", allow_fallback: bool = True) -> LLMProvider:
    return EchoProvider() if provider is None else _load(ChatProvider, EchoProvider, "language model", allow_fallback)


def get_token_counter(model: str | None = EMBEDDER, allow_fallback: bool = True) -> TokenCounter:
    return HeuristicCounter() if model is None else _load(lambda: ModelCounter(model), HeuristicCounter, "tokenizer", allow_fallback)


def get_segmenter(lang: str, allow_fallback: bool = True) -> tuple[str, Callable[[Column], Column]]:
    """(name, text -> terms).  Japanese asks for a morphological analyser and falls back to character bigrams."""
    if lang != "ja":
        return "whitespace", lambda t: segments(t, F.lit(lang))

    def analyser():
        from sudachipy import dictionary

        dictionary.Dictionary().create()

        @F.pandas_udf("array<string>")
        def cut(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":  # noqa: F821, UP037
            from sudachipy import dictionary, tokenizer

            made = dictionary.Dictionary().create()
            for texts in batches:
                yield texts.map(lambda t: [m.surface() for m in made.tokenize(t, tokenizer.Tokenizer.SplitMode.C) if m.surface().strip()])

        return "sudachi", cut

    return _load(analyser, lambda: ("char-bigram", lambda t: segments(t, F.lit("ja"))), "Japanese segmenter", allow_fallback)


def get_cut(allow_fallback: bool = True) -> dict:
    """The cut of an index and the segmenter's name: Japanese by ``get_segmenter``, other languages by words."""
    name, japanese = get_segmenter("ja", allow_fallback)
    if name == "char-bigram":
        return {"cut": segments, "segmenter": name}
    return {"cut": lambda text, lang: F.when(lang == "ja", japanese(text)).otherwise(segments(text, lang)), "segmenter": name}


VERIFIERS = ("lexical", "embedding", "nli", "llm-judge")


def get_verifier(method: str, *, llm: LLMProvider | None = None, embedder: Embedder | None = None, allow_fallback: bool = False):
    """(claims, evidence) -> verdicts, of one of the four arms."""
    if method == "lexical":
        return verification.lexical
    if method == "embedding":
        if embedder is None:
            raise ValueError("method 'embedding' needs an embedder")

        def by_vector(claims, evidence):
            c = claims.withColumn("claim_vec", embedder.embed_query(F.col("claim")))
            e = evidence.withColumn("evidence_vec", embedder.embed_passages(F.col("evidence")))
            return verification.embedding(c, e, name=embedder.name)

        return by_vector
    if method == "llm-judge":
        if llm is None:
            raise ValueError("method 'llm-judge' needs a language model")
        return lambda claims, evidence: verification.judged(claims, evidence, llm)
    if method == "nli":
        return _load(_model_nli, lambda: verification.fake, "entailment model", allow_fallback)
    raise ValueError(f"unknown verification method {method!r}; expected one of {VERIFIERS}")


def _model_nli(model: str = NLI_MODEL):
    import transformers

    transformers.AutoConfig.from_pretrained(model)

    @F.pandas_udf("struct<entailment:double,contradiction:double>")
    def judge(batches: "Iterator[tuple[pd.Series, pd.Series]]") -> "Iterator[pd.DataFrame]":  # noqa: F821, UP037
        import torch
        import transformers

        cut, net = transformers.AutoTokenizer.from_pretrained(model), transformers.AutoModelForSequenceClassification.from_pretrained(model).eval()
        names = {i: n.lower() for i, n in net.config.id2label.items()}
        for premise, claim in batches:
            with torch.no_grad():
                p = torch.softmax(net(**cut(list(premise), list(claim), return_tensors="pt", padding=True, truncation=True, max_length=512)).logits, -1).numpy()
            rows = pd.DataFrame({names[i]: p[:, i] for i in range(p.shape[1])})
            yield rows.reindex(columns=["entailment", "contradiction"], fill_value=0.0).astype(float)

    def by_model(claims, evidence):
        p = claims.join(evidence, "answer_id").withColumn("p", judge(F.col("evidence"), F.col("claim")))
        return verification.nli(claims, p.select("answer_id", "claim_index", "evidence_index", "p.entailment", "p.contradiction"), name=model)

    return by_model


def get_decomposer(mode: str = "sentence", llm: LLMProvider | None = None):
    """(answers with text) -> claims."""
    if mode == "sentence":
        return verification.sentence_claims
    if mode == "llm":
        if llm is None:
            raise ValueError("decomposition by a model needs a language model")
        return lambda answers: verification.line_claims(answers.withColumn("reply", llm.generate(prompts.decompose_prompt(F.col("text")))))
    raise ValueError(f"unknown decomposer {mode!r}; expected 'sentence' or 'llm'")
