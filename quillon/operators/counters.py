"""Token counters that chunkers take.

A counter has a ``name``, ``sizes(texts)``, the Column of sizes of an array of texts, and
``groups(texts, least)``, which sections to carry into the next one: ranges whose joined text
has ``least`` tokens, and a last one marked small if it has not.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK_CHARS_PER_TOKEN, OTHER_CHARS_PER_TOKEN, cjk_count, token_count

_GROUPS = "array<struct<first:int,last:int,small:boolean>>"
#: texts of one page are joined by a blank line
GAP = "\n\n"
#: a vocabulary is broadcast; a larger one is refused
MAX_VOCABULARY_BYTES = 64 << 20
#: what stands for the space before a word, and how far below the rarest piece an unknown character is
MARK, UNKNOWN = "\u2581", 10.0
#: words whose counts a worker remembers
MOST_SEEN = 1 << 18


def _ranges(n: int, big_enough: Callable[[int, int], bool]) -> list[dict]:
    """Ranges of n sections, each closed as soon as ``big_enough(first, last)``; what is left is small."""
    out, first = [], 0
    for i in range(n):
        if big_enough(first, i):
            out.append({"first": first, "last": i, "small": False})
            first = i + 1
    if first < n:
        out.append({"first": first, "last": n - 1, "small": True})
    return out


class HeuristicCounter:
    """One token for 1.1 CJK or 4 other characters: sizes never leave the JVM."""

    name = "heuristic"

    @staticmethod
    def _size(cjk: int, other: int) -> int:
        return max(1, round(cjk / CJK_CHARS_PER_TOKEN + other / OTHER_CHARS_PER_TOKEN)) if cjk + other else 0

    def sizes(self, texts: Column) -> Column:
        return F.transform(texts, token_count)

    def groups(self, texts: Column, least: int) -> Column:
        """From the numbers of characters of each kind, which add up when texts are joined."""

        @F.pandas_udf(_GROUPS)
        def carry(cjk: pd.Series, chars: pd.Series) -> pd.Series:
            def page(c, n):
                if c is None:
                    return None
                wide, long = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(n)))

                def enough(a, b):
                    x = int(wide[b + 1] - wide[a])
                    return self._size(x, int(long[b + 1] - long[a]) + len(GAP) * (b - a) - x) >= least

                return _ranges(len(c), enough)

            return pd.Series([page(c, n) for c, n in zip(cjk, chars, strict=True)], dtype=object)

        return carry.asNondeterministic()(F.transform(texts, cjk_count), F.transform(texts, F.length))


class TextCounter:
    """A counter that needs the texts: ``loader`` makes, in a Python worker, the function that counts one."""

    def __init__(self, name: str, loader: Callable[[], Callable[[str], int]]):
        self.name, self._loader = name, loader

    def sizes(self, texts: Column) -> Column:
        loader = self._loader

        @F.pandas_udf("array<int>")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens = loader()
            for pages in batches:
                yield pages.map(lambda page: [tokens(t) for t in page] if page is not None else None)

        return count.asNondeterministic()(texts)

    def groups(self, texts: Column, least: int) -> Column:
        """Counts each section once, and what is carried again with what it joins."""
        loader = self._loader

        @F.pandas_udf(_GROUPS)
        def carry(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens = loader()
            for pages in batches:
                yield pages.map(lambda page: _ranges(len(page), lambda a, b: tokens(GAP.join(page[a : b + 1])) >= least) if page is not None else None)

        return carry.asNondeterministic()(texts)


class ModelCounter(TextCounter):
    """Tokens of a model's own tokenizer."""

    def __init__(self, model: str):
        import transformers

        transformers.AutoTokenizer.from_pretrained(model)

        def loader():
            loaded = transformers.AutoTokenizer.from_pretrained(model)
            return lambda t: len(loaded.encode(t, add_special_tokens=False))

        super().__init__(f"model:{model}", loader)


class FileCounter(TextCounter):
    """Tokens of a tokenizer file that all workers can read: a ``tokenizers`` JSON or a ``sentencepiece`` model."""

    def __init__(self, path: str):
        def loader():
            if path.endswith(".model"):
                import sentencepiece

                pieces = sentencepiece.SentencePieceProcessor(model_file=path)
                return lambda t: len(pieces.encode(t))
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            return lambda t: len(tok.encode(t, add_special_tokens=False).ids)

        loader()
        super().__init__(f"file:{os.path.basename(path)}", loader)


class UnigramCounter(TextCounter):
    """Pieces of the likeliest segmentation under a vocabulary (piece, score) with log probabilities.

    Words have ``MARK`` in front of them, as unigram vocabularies write them.  A character that
    no piece covers is one token, at ``UNKNOWN`` below the rarest piece.  The vocabulary is a
    bounded table, which is collected and broadcast.
    """

    def __init__(self, vocabulary: DataFrame, name: str = "vocabulary"):
        size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("piece") + 64), F.lit(0)).alias("b")).first().b
        if size > MAX_VOCABULARY_BYTES:
            raise ValueError(f"a vocabulary of {size} bytes is larger than {MAX_VOCABULARY_BYTES}")
        rows = vocabulary.where("piece <> '' and score is not null").groupBy("piece").agg(F.max(F.col("score").cast("double")).alias("score")).collect()
        shared = vocabulary.sparkSession.sparkContext.broadcast({r.piece: r.score for r in rows})
        super().__init__(f"unigram:{name}", lambda: unigram_reader(shared.value))


def unigram_reader(table: dict[str, float]) -> Callable[[str], int]:
    """The function that counts a text's tokens; words that come again are remembered."""
    longest, floor = max(map(len, table), default=1), min(table.values(), default=0.0) - UNKNOWN
    seen: dict[str, int] = {}

    def word(text: str) -> int:
        best, count = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - longest), j):
                p = table.get(text[i:j], floor if j == i + 1 else None)
                if p is not None and best[i] + p > best[j]:
                    best[j], count[j] = best[i] + p, count[i] + 1
        return count[-1]

    def tokens(text: str) -> int:
        total = 0
        for w in text.split():
            if w not in seen:
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen[w] = word(MARK + w)
            total += seen[w]
        return total

    return tokens


HEURISTIC = HeuristicCounter()
#: one token a word
WORDS = TextCounter("words", lambda: lambda t: len(t.split()))
