"""Markdown pages to blocks of text under heading paths, as Column expressions.

Each line becomes one number: a fence mark, a heading's level, or neither.  Only these
numbers go to Python, where one pass finds the lines of each block and the headings above
it; texts are cut, cleaned and joined in the JVM.  A page's cost is linear in its lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .frontmatter import header_map
from .text import let, replace_each, strip

# fixed values: the patterns of the page format
FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
SHORTCODE = r"(?s)\{\{[<%]\s*(/)?\s*([A-Za-z0-9_.-]+)([^}]*?)[>%]\}\}"
COMMENT = r"(?s)<!--.*?-->"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]+)\]\([^)]*\)"
TAG = r"(?i)</?(?:br|hr|img|div|span|p|a|b|i|em|strong)\b[^>]*/?>"
HEADING = r"\A(#{1,6})\s+(.*?)\s*#*\s*\z"
FENCE = r"\A\s*(```|~~~)"
ANCHOR = r"\s*\{#[^}]*\}\s*\z"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def front_matter_body(raw: Column) -> Column:
    """The page after its front matter."""
    return F.regexp_replace(raw, FRONT_MATTER, "")


def front_matter(raw: Column) -> Column:
    """map<string,string> of the front matter; empty if there is none or it is malformed."""
    return header_map(F.regexp_extract(raw, FRONT_MATTER, 1))


def front_matter_title(raw: Column) -> Column:
    """The ``title`` of the front matter; null if there is none."""
    return F.nullif(F.try_element_at(front_matter(raw), F.lit("title")), F.lit(""))


def _attribute(raw: Column, name: str) -> Column:
    return F.regexp_extract(raw, rf'(?s).*(?<![A-Za-z0-9_-]){name}\s*=\s*"([^"]*)"', 1)


def shortcode_text(tag: Column) -> Column:
    """What one shortcode renders to in the running text; wrappers and closing tags render to nothing."""
    name, raw = F.lower(F.regexp_extract(tag, SHORTCODE, 2)), F.regexp_extract(tag, SHORTCODE, 3)
    shown, term = _attribute(raw, "text"), _attribute(raw, "term_id")
    state, release, gate = _attribute(raw, "state"), _attribute(raw, "for_k8s_version"), _attribute(raw, "feature_gate_name")
    stage = F.array_join(F.filter(F.array(state, release), lambda x: x != ""), ", ")
    return (
        F.when(name == "glossary_tooltip", F.when(shown != "", shown).otherwise(F.translate(term, "-_", "  ")))
        .when(name == "glossary_definition", _attribute(raw, "prepend"))
        .when(
            name == "feature-state",
            F.when(stage != "", F.concat(F.lit("(feature state: "), stage, F.lit(")")))
            .when(gate != "", F.concat(F.lit("(feature gate: "), gate, F.lit(")")))
            .otherwise(""),
        )
        .when(name == "heading", F.regexp_extract(raw, r'"([^"]*)"', 1))
        .otherwise("")
    )


def clean_inline(text: Column) -> Column:
    """The words of marked-up text: no comments, shortcodes rendered, no images, links as their text, no inline tags."""
    text = replace_each(F.regexp_replace(text, COMMENT, ""), SHORTCODE, shortcode_text)
    text = F.regexp_replace(F.regexp_replace(text, IMAGE, ""), LINK, "$1")
    return F.regexp_replace(text, TAG, "")


#: what a line is: a fence mark, or a heading of a level whose title is some text or none
_FENCES, _TITLED, _UNTITLED = {1, 2}, 10, 20


def outline(kinds) -> list[dict]:
    """Line ranges of the blocks between headings, each with the lines of the headings above it."""
    out, above, first, fence = [], [], 0, 0
    for i, kind in enumerate(kinds):
        if kind in _FENCES:
            fence = kind if not fence else 0 if fence == kind else fence
        elif kind and not fence:
            if i > first:
                out.append({"first": first, "n": i - first, "path": [h for _, h in above]})
            level = kind % 10
            while above and above[-1][0] >= level:
                above.pop()
            if kind < _UNTITLED:
                above.append((level, i))
            first = i + 1
    if len(kinds) > first:
        out.append({"first": first, "n": len(kinds) - first, "path": [h for _, h in above]})
    return out


def _outline(kinds: Column) -> Column:
    @F.pandas_udf("array<struct<first:int,n:int,path:array<int>>>")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda k: outline(k.tolist()) if k is not None else None)

    # else the optimiser would put it into the lambdas that read its result, where Python cannot run
    return read.asNondeterministic()(kinds)


def _kind(line: Column, title: Column) -> Column:
    mark, level = F.regexp_extract(line, FENCE, 1), F.length(F.regexp_extract(line, HEADING, 1))
    heading = F.when(level > 0, level + F.when(title == "", _UNTITLED).otherwise(_TITLED)).otherwise(0)
    return F.when(mark == "```", 1).when(mark == "~~~", 2).otherwise(heading).cast("int")


def _title(line: Column) -> Column:
    title = F.regexp_extract(line, HEADING, 2)
    return F.when(line.rlike(HEADING), strip(F.regexp_replace(clean_inline(title), ANCHOR, ""))).otherwise("")


def _block_text(lines: Column) -> Column:
    return let(F.array_join(lines, "\n"), lambda t: strip(F.regexp_replace(clean_inline(t), r"\n{3,}", "\n\n")))


def blocks(body: Column) -> Column:
    """array<struct<section_path, text>> of a page's body; empty blocks are left out; null of null."""
    lines = F.split(F.regexp_replace(body, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)
    titles = F.transform(lines, _title)
    kinds = F.zip_with(lines, titles, _kind)
    page = F.struct(lines.alias("lines"), titles.alias("titles"), _outline(kinds).alias("ranges"))

    def of(p):
        def block(r):
            path = F.transform(r["path"], lambda h: F.get(p["titles"], h))
            return F.struct(path.alias("section_path"), _block_text(F.slice(p["lines"], r["first"] + 1, r["n"])).alias("text"))

        return F.filter(F.transform(p["ranges"], block), lambda b: b["text"] != "")

    return let(page, of)


def page_title(raw: Column, fallback: Column) -> Column:
    return strip(F.coalesce(front_matter_title(raw), fallback, F.lit("")))


def parsed_page(raw: Column, fallback: Column) -> Column:
    """struct<title, front_matter, blocks> of a page."""
    return F.struct(page_title(raw, fallback).alias("title"), front_matter(raw).alias("front_matter"), blocks(front_matter_body(raw)).alias("blocks"))


# web pages: the same block form from h1-h6 and paragraph-like elements

_DROPPED = r"(?is)<(script|style|nav|footer|header|aside|form)\b.*?</\1\s*>|<!--.*?-->"


def html_blocks(html: Column) -> Column:
    """Blocks of a web page: headings make paths, other elements break lines, entities of the common kind are read."""
    t = F.regexp_replace(html, _DROPPED, " ")
    t = F.regexp_replace(t, r"(?is)^.*?<body\b[^>]*>", "")
    t = F.regexp_replace(t, r"\s+", " ")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", "\n" + "#" * n + " $1\n")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|li|ul|ol|tr|table|br|section|article|blockquote|pre)\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return blocks(F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", ""))
