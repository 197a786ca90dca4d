"""Text primitives against plain Python."""

import hashlib
import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import frontmatter, markdown, text

TEXTS = [
    "", " ", "Wow!! Next one. lower case. Next", "これはペンです。次の文！終わり", "Mixed 日本語 text with ペン and words. 123 Go", "a" * 41, "!!!", "É accent. Über alles. Next",
    "one_two three-four’s", "漢字かなカナ ab", "tab\tand\nnewline. New", "ｱｲｳ half",
]
CJK = re.compile("[぀-ゟ゠-ヿ一-鿿ｦ-ﾟ]")


def column(spark, expr, values=TEXTS):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select(expr(F.col("t")), "i").orderBy("i").collect()]


def test_script(spark):
    def plain(t):
        letters = sum(unicodedata.category(c)[0] == "L" for c in t)
        return "none" if not letters else "cjk" if len(CJK.findall(t)) / letters > 0.3 else "latin"

    assert column(spark, text.script_of) == [plain(t) for t in TEXTS]


def test_token_count(spark):
    def plain(t):
        c = len(CJK.findall(t))
        return max(1, round(c / 1.1 + (len(t) - c) / 4)) if t else 0

    assert column(spark, text.token_count) == [plain(t) for t in TEXTS]
    assert column(spark, text.token_count, ["a" * 10, "a" * 6, "a" * 14]) == [2, 2, 4]  # half goes to even


def test_sentences(spark):
    rule = re.compile(r"(?<=[。．！？!?])\s*|(?<=[.!?])\s+(?=[A-Z0-9])")
    assert column(spark, text.sentences) == [[p.strip() for p in rule.split(t) if p.strip()] for t in TEXTS]
    assert column(spark, text.sentences, ["Wow!!"]) == [["Wow!", "!"]]


def test_terms(spark):
    assert column(spark, text.words) == [re.findall(r"[^\W]+", t.lower()) for t in TEXTS]
    bigrams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)] or ([s] if s else [])
    assert column(spark, text.char_bigrams) == [bigrams(re.sub(r"\s+", "", t)) for t in TEXTS]
    got = column(spark, lambda t: text.segments(t, text.query_lang(t)), ["日本語です", "Two Words"])
    assert got == [["日本", "本語", "語で", "です"], ["two", "words"]]


def test_ids(spark):
    cid = hashlib.sha1(b"en:a|fixed|3").hexdigest()[:16]
    row = spark.range(1).select(text.make_chunk_id(F.lit("en:a"), F.lit("fixed"), F.lit(3)).alias("c")).select("c", text.point_id(F.col("c"))).first()
    assert row[0] == cid and row[1] == int(cid, 16) & (2**63 - 1)


@pytest.mark.parametrize("a,b,want", [(["a", "b"], ["a", "c"], ["a"]), ([], ["a"], []), (["a"], ["a", "b"], ["a"]), (["x"], ["y"], []), (["a", "b"], ["a", "b"], ["a", "b"])])
def test_common_prefix(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(text.common_prefix(F.col("a"), F.col("b"))).first()[0] == want


def test_keep_path(spark):
    paths = ["docs/a/b.md", "docs/reference/x.md", "docs/a/_index.md", "blog/x.md", "docs/a/includes/x.md", "docs/contribute/x.md", "docs/test/x.md", "docs/x.txt", "docs/glossary/x.md"]
    assert column(spark, text.keep_path, paths) == [True] + [False] * 8
    assert column(spark, lambda c: text.keep_path(c, True), paths)[:2] == [True, True]


def test_judge_and_lines(spark):
    assert column(spark, text.judge_label, ["SUPPORTED", "unsupported.", "It CONTRADICTS", "[ECHO]", ""]) == ["supported", "unsupported", "contradicted", "unsupported", "unsupported"]
    assert column(spark, text.claim_lines, ["- a\n\n* b \r\n  c", ""]) == [["a", "b", "c"], []]


PAGE = """---
title: "My Page"
---
intro {{< glossary_tooltip text="Pod" term_id="pod" >}} and {{< glossary_tooltip term_id="replica-set" >}}.

# Head {#anchor}
para [link](http://x) ![i](y) <b>bold</b><!-- gone
-->
```yaml
# not a heading
```
## Sub ##
{{< note >}}keep me{{< /note >}} {{< feature-state for_k8s_version="v1.2" state="beta" >}}{{< param "v" >}}



### {{< heading "whatsnext" >}}
a
~~~
```
# still code
~~~
# Top2
x
#### Deep
y
"""


def test_markdown(spark):
    df = spark.createDataFrame([(PAGE,), ("no front matter",), ("",)], "raw string")
    got = df.select(markdown.page_title(F.col("raw"), F.lit("fallback")), markdown.blocks(markdown.front_matter_body(F.col("raw")))).collect()
    assert [r[0] for r in got] == ["My Page", "fallback", "fallback"]
    assert [(list(b.section_path), b.text) for b in got[0][1]] == [
        ([], "intro Pod and replica set."),
        (["Head"], "para link  bold\n```yaml\n# not a heading\n```"),
        (["Head", "Sub"], "keep me (feature state: beta, v1.2)"),
        (["Head", "Sub", "whatsnext"], "a\n~~~\n```\n# still code\n~~~"),
        (["Top2"], "x"),
        (["Top2", "Deep"], "y"),
    ]
    assert [b.text for b in got[1][1]] == ["no front matter"] and got[2][1] == []


def test_shortcodes(spark):
    cases = {
        '{{< feature-state feature_gate_name="G" >}}': "(feature gate: G)", "{{< feature-state >}}": "", '{{% glossary_definition prepend="A pod is" %}}': "A pod is",
        "{{< unknown >}}x{{< /unknown >}}": "x", '{{< GLOSSARY_TOOLTIP term_id="a_b-c" >}}': "a b c",
    }
    assert column(spark, markdown.clean_inline, list(cases)) == list(cases.values())


def test_html_blocks(spark):
    html = "<html><body><nav>x</nav><h1>Top</h1><p>one &amp; two<br>three</p><script>bad()</script><h2>Sub</h2><ul><li>item</ul></body></html>"
    got = column(spark, markdown.html_blocks, [html])[0]
    assert [(list(b.section_path), b.text) for b in got] == [(["Top"], "one & two\n\nthree"), (["Top", "Sub"], "item")]


def test_log2_is_what_metrics_use(spark):
    assert spark.range(1).select(F.log2(F.lit(3.0))).first()[0] == pytest.approx(math.log2(3))


HEADERS = {
    "title: Pods\nweight: 20": {"title": "Pods", "weight": "20"},
    "title: [unclosed": {},
    "title: \"a \\\"b\\\" \\u00e9\"\nx: 'it''s'": {"title": 'a "b" é', "x": "it's"},
    "tags: [a, 'b c', \"d\"]\nm: {a: 1, b: two}": {"tags": '["a", "b c", "d"]', "m.a": "1", "m.b": "two"},
    "s: >-\n  one\n  two\n\n  three\nl: |\n  a\n   b\n  c\n": {"s": "one two\nthree", "l": "a\n b\nc\n"},
    "o:\n  name: x\n  n: 3\nal:\n- /a\n- name: q\n  v: 1": {"o.name": "x", "o.n": "3", "al": '["/a", {"name": "q", "v": "1"}]'},
    "a: # comment\nb: x # c\nu: http://x/y#z": {"a": None, "b": "x", "u": "http://x/y#z"},
    "title: multi\n  line here\nq: \"x\n  y\"": {"title": "multi line here", "q": "x y"},
    "x: ~\ny: null\nz: ''": {"x": None, "y": None, "z": ""},
    "a: >\n\n  x\n\n\n  y\n   z\nb: 2": {"a": "\nx\n\ny\n z\n", "b": "2"},
    "- a\n- b": {}, "just text": {}, "a: b: c": {}, "a:\n\tb: 1": {}, "# only a comment": {}, "a: @x": {}, "a: 'open": {}, "a: *ref": {}, 'a: "b" c': {}, "a: x\n b: y": {}, "d: - x": {},
    "title: C++: the # thing": {}, "title: Using x -- y, [z]": {"title": "Using x -- y, [z]"},
}


@pytest.mark.parametrize("header", HEADERS)
def test_front_matter_values(header):
    assert frontmatter.parse(header) == HEADERS[header]


def test_front_matter_against_a_library():
    """Random headers of the supported forms; what the library refuses is empty here."""
    yaml = pytest.importorskip("yaml")
    rng = random.Random(12)
    atoms = ["x", "two words", "'q''s'", '"d \\t e"', "~", "12", "a:b", "http://h/p#f", "", "# note", "[a, b]", "{k: v}", "[", "a: b", "- z", "|\n    l1\n\n    l2", ">-\n    f1\n    f2", "x # c", "!t y", "\n    nested: 1\n    other: '2'", "\n  - i\n  - j"]
    for _ in range(1500):
        text = "\n".join(f"{rng.choice(['title', 'k1', 'two words', '  deep', '- i'])}: {rng.choice(atoms)}" for _ in range(rng.randint(1, 4)))
        try:
            want = yaml.load(text, Loader=yaml.BaseLoader)
        except yaml.YAMLError:
            want = {}
        if "!t" in text or text.startswith("  ") and "\n" in text:
            continue
        want = want if isinstance(want, dict) else {}
        flat = {}
        for k, v in want.items():
            flat |= {f"{k}.{a}": b for a, b in v.items()} if isinstance(v, dict) else {k: v}
        flat = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v for k, v in flat.items()}
        got = frontmatter.parse(text)
        plain = lambda m: {k: "" if v in ("~", None) else v.replace("null", '""').replace('"~"', '""') for k, v in m.items()}
        assert plain(got) == plain(flat), text


def test_parsed_page(spark):
    df = spark.createDataFrame([(PAGE,), ("---\ntitle: [unclosed\n---\nBody\n",), ("Just text.\n",), ("---\r\ntitle: 'T'\r\nweight: 3\r\n---\r\nx",), (None,), ("",)], "raw string")
    got = [r[0] for r in df.select(markdown.parsed_page(F.col("raw"), F.lit("fallback"))).collect()]
    assert [(r.title, len(r.blocks or []), r.front_matter.get("weight")) for r in got] == [("My Page", 6, got[0].front_matter.get("weight")), ("fallback", 1, None), ("fallback", 1, None), ("T", 1, "3"), ("fallback", 0, None), ("fallback", 0, None)]
    assert got[1].front_matter == {} and got[1].blocks[0].text == "Body"
