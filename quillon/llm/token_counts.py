"""Token counts of whole texts by a two-tier lookup on the map side.

A byte-level BPE works inside pre-tokens, so a text's count is the sum of its pre-tokens'
lengths in tokens.  Tier one is a broadcast table of the lengths of frequent pre-tokens;
what it misses is encoded by the library and kept in a bounded cache of the Python worker,
which outlives its tasks.  No pre-token is ever shuffled: each row is counted where it is read.

The frequent pre-tokens come from a bounded sample of texts.  The table decides only how
fast a count is found: with an empty one every count is the same.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: texts from which the frequent pre-tokens are taken, about
SAMPLE_TEXTS = 8192
#: entries of the broadcast table
TABLE_SIZE = 1 << 16
#: longer pre-tokens are neither in the table nor cached
LONGEST_KEPT = 64
#: entries of a worker's cache, which starts anew when it is full
CACHE_SIZE = 1 << 18
#: pre-tokens of a text handled at once
PIECES_AT_ONCE = 1 << 16
#: the tokenizer's file travels in a broadcast; a larger one is refused
MAX_FILE_BYTES = 64 << 20

# fixed value: the pre-token pattern of byte-level BPE vocabularies
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text; ValueError where counts of pre-tokens would not add up to the text's."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    tame = not any(t[k] for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or spec.get("normalizer") or not tame or model.get("type") != "BPE" or model.get("dropout"):
        raise ValueError("a byte-level BPE without normalizer, prefix space or stripping special tokens is needed")
    return raw


class PieceCounter:
    """Pre-tokens of texts and their lengths in tokens, as the library has them."""

    def __init__(self, raw: str, table: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(raw)
        self.tok.no_truncation()
        self.tok.no_padding()
        specials = sorted((t["content"] for t in json.loads(raw).get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pieces = regex.compile(PIECES)
        self.table = table or {}
        self.cache: dict[str, int] = {}
        self.agreed, self.odd = set(map(chr, range(128))), set()
        self.misses = 0

    def _regex_cuts(self, text: str) -> bool:
        """Whether the pattern's character classes here and in the library agree on all of the text."""
        if text.isascii():
            return True
        seen = set(text)
        for c in seen - self.agreed - self.odd:
            probe = f"a{c}b 1{c}2 .{c}. {c} {c}{c}x"
            theirs = [span for _, span in self.tok.pre_tokenizer.pre_tokenize_str(probe)]
            same = theirs == [m.span() for m in self.pieces.finditer(probe)]
            (self.agreed if same else self.odd).add(c)
        return self.odd.isdisjoint(seen)

    def cut(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens of a text without special strings."""
        if not self._regex_cuts(text):
            yield [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        elif len(text) <= PIECES_AT_ONCE:
            yield self.pieces.findall(text)
        else:
            found = self.pieces.finditer(text)
            while some := [m.group() for m in islice(found, PIECES_AT_ONCE)]:
                yield some

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those stand in it."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        found = self.special.split(text)
        return found, len(found) - 1

    def lengths(self, misses: list[str]) -> int:
        """Tokens of pre-tokens that the table lacks: from the cache, or encoded and cached."""
        got = list(map(self.cache.get, misses))
        new = list({p for p, n in zip(misses, got, strict=True) if n is None})
        if not new:
            return sum(got)
        self.misses += len(new)
        fresh = {p: len(e.ids) for p, e in zip(new, self.tok.encode_batch(new, add_special_tokens=False), strict=True)}
        total = sum(n if n is not None else fresh[p] for p, n in zip(misses, got, strict=True))
        if len(self.cache) + len(fresh) > CACHE_SIZE:
            self.cache.clear()
        self.cache.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_KEPT)
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        parts, total = self.parts(text)
        for part in parts:
            for pieces in self.cut(part):
                got = list(map(self.table.get, pieces))
                if None in got:
                    total += self.lengths([p for p, n in zip(pieces, got, strict=True) if n is None])
                    total += sum(filter(None, got))
                else:
                    total += sum(got)
        return total


#: the Python worker's counters, which stay between its tasks
_counters: dict[str, PieceCounter] = {}


def _packed(table: dict[str, int]) -> bytes:
    """The table as one Arrow buffer: joined strings, offsets and two bytes for each length."""
    batch = pa.RecordBatch.from_arrays([pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.uint16())], ["piece", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _worker_counter(key: str, raw, packed) -> PieceCounter:
    if key not in _counters:
        _counters.clear()
        batch = pa.ipc.open_stream(packed.value).read_all()
        _counters[key] = PieceCounter(raw.value, dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    return _counters[key]


def _tally(raw):
    """The commonest pre-tokens of a stream of texts; rare ones are let go when a fixed number is exceeded."""

    def run(batches):
        counter, seen = PieceCounter(raw.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in counter.parts(text)[0]:
                    for pieces in counter.cut(part):
                        seen.update(p for p in pieces if len(p) <= LONGEST_KEPT)
                        if len(seen) > 4 * TABLE_SIZE:
                            seen = Counter(dict(seen.most_common(2 * TABLE_SIZE)))
        top = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE]]
        lengths = [len(e.ids) for e in counter.tok.encode_batch(top, add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(lengths, pa.int32())], ["piece", "n"])

    return run


def frequent_pieces(docs: DataFrame, text_col: str, raw, sample_texts: int = SAMPLE_TEXTS) -> dict[str, int]:
    """Lengths of at most ``TABLE_SIZE`` pre-tokens that are frequent in about ``sample_texts`` texts.

    One task reads the sampled texts as a stream and holds a bounded tally.
    """
    if sample_texts <= 0:
        return {}
    n = docs.count()
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if n > sample_texts:
        texts = texts.sample(False, sample_texts / n, 11)
    rows = texts.repartition(1).mapInArrow(_tally(raw), "piece string, n int").collect()
    return {r.piece: r.n for r in rows}


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample_texts: int = SAMPLE_TEXTS
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``; ids keep their type.

    The tokenizer file at ``path`` is read on the driver and broadcast.  A null text counts as
    an empty one, of no bytes and no tokens.  Rows with a null or repeated id are each counted;
    an empty table gives no row; other columns are not read.  A text of any length is counted
    whole, ``PIECES_AT_ONCE`` pre-tokens at a time.
    """
    sc, id_type = docs.sparkSession.sparkContext, docs.schema[id_col].dataType
    text = read_tokenizer(path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    raw = sc.broadcast(text)
    packed = _packed(frequent_pieces(rows, "text", raw, sample_texts))
    key = hashlib.sha256(text.encode() + packed).hexdigest()
    table = sc.broadcast(packed)

    def run(batches):
        counter = _worker_counter(key, raw, table)
        for batch in batches:
            n = [counter.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(
        run, f"id {id_type.simpleString()}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every document by the public byte-level vocabulary, or by the tokenizer at ``path``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, path).withColumnRenamed("id", "doc_id")
