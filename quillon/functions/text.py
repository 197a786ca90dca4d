"""Text primitives as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scripts, ratios and separators
CJK = r"[぀-ゟ゠-ヿ一-鿿ｦ-ﾟ]"
CJK_CHARS_PER_TOKEN, OTHER_CHARS_PER_TOKEN = 1.1, 4.0
CJK_SHARE = 0.3
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = r"(?U)(?<=[。．！？!?])\s*|(?<=[.!?])\s+(?=[A-Z0-9])"
TRAIL = " › "

#: whitespace as str.strip() sees it
_EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once however often ``body`` reads it, lambdas included."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def replace_each(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``by(match)``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern, -1)
    tail = F.zip_with(hits, F.slice(rest, 2, F.size(hits)), lambda h, r: F.concat(by(h), r))
    joined = F.concat(F.element_at(rest, 1), F.array_join(tail, ""))
    return F.when(F.size(hits) > 0, joined).otherwise(text)


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def script_of(text: Column) -> Column:
    """'none' without letters, 'cjk' if more than 0.3 of the letters are, else 'latin'."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters == 0, "none").when(cjk_count(text) / letters > CJK_SHARE, "cjk").otherwise("latin")


def token_count(text: Column) -> Column:
    """Approximate model tokens: one for 1.1 CJK or 4 other characters, half-even, at least 1 unless empty."""
    cjk = cjk_count(text)
    n = F.bround(cjk / CJK_CHARS_PER_TOKEN + (F.length(text) - cjk) / OTHER_CHARS_PER_TOKEN)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), n)).cast("int")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_BREAK), strip)
    return F.filter(parts, lambda p: p != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def char_bigrams(text: Column) -> Column:
    """Neighbouring characters of a text without its spaces; a single one stands alone."""

    def pairs(c):
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.when(F.size(c) < 2, c).otherwise(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.concat(a, b)))

    dense = F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", "")
    return let(F.regexp_extract_all(dense, F.lit("(?s)."), F.lit(0)), pairs)


def segments(text: Column, lang: Column) -> Column:
    """Terms of a text: character bigrams for Japanese, lower-cased words for all else."""
    return F.when(lang == "ja", char_bigrams(text)).otherwise(words(text))


def query_lang(text: Column) -> Column:
    return F.when(script_of(text) == "cjk", "ja").otherwise("en")


def make_chunk_id(doc_id: Column, strategy: Column, ordinal: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", doc_id, strategy, ordinal.cast("string")).cast("binary")), 1, 16)


def point_id(chunk_id: Column) -> Column:
    """The chunk id's 64 bits as a non-negative bigint."""
    return F.conv(chunk_id, 16, -10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def heading_trail(title: Column, path: Column) -> Column:
    return F.array_join(F.concat(F.array(title), path), TRAIL)


def for_embedding(title: Column, path: Column, text: Column) -> Column:
    return F.concat(heading_trail(title, path), F.lit("\n\n"), text)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(at, lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.slice(a, F.lit(1), F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n))


def keep_path(rel: Column, include_reference: bool = False) -> Column:
    """Whether a path under a language root is a page of the corpus."""
    keep = rel.startswith("docs/") & rel.endswith(".md") & ~rel.endswith("/_index.md")
    for part in ("/includes/", "/_common-resources/", "/glossary/"):
        keep = keep & ~F.concat(F.lit("/"), rel).contains(part)
    for top in ("docs/contribute/", "docs/test/", *(() if include_reference else ("docs/reference/",))):
        keep = keep & ~rel.startswith(top)
    return keep


def humanised_stem(rel: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(rel, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.replace(stem, F.lit("-"), F.lit(" "))


def judge_label(raw: Column) -> Column:
    """The verdict that a judge's reply names; a reply that names none supports nothing."""
    t = F.upper(raw)
    return (
        F.when(t.contains("CONTRADICT"), "contradicted").when(t.contains("UNSUPPORTED"), "unsupported").when(t.contains("SUPPORTED"), "supported").otherwise("unsupported")
    )


def claim_lines(reply: Column) -> Column:
    """One claim for each line of a reply, without bullets; blank lines are none."""
    lines = F.transform(F.split(reply, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", ""))
    return F.filter(lines, lambda x: strip(x) != "")
