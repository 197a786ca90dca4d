"""Personal data by boosted scoring of proposed spans, in DataFrame operations only.

Generators propose spans of four kinds: the base patterns, and wider ones (bracketed "at"
and "dot", national phone formats, cards with other separators, defanged addresses), which
may overlap.  A span has format features (separators, brackets, variety) and context features
(the characters beside it, an identifier's word or sign or a number before it, other candidates
nearby), all in a few bins.  Only spans that pass their kind's exact check (a top-level domain of
letters, octets up to 255, a Luhn sum, the digits of a phone number) and that no base span
covers are candidates.  Boosted trees of depth two are fitted on the counts of feature patterns
over the whole input: positive are base spans, and wider ones with a cue word or a label before
them, which no feature states; negative are spans that pass by chance inside something else,
joined to letters or digits or behind the word or sign of an identifier, price, date or version;
wider spans with neither are not learnt from.  Half of the texts, by hash, fit the trees, the
others calibrate: a kind's threshold is the lowest score t from which its spans there, and
``SHRINK`` more of precision t, have a precision of ``PRECISION``.  Base spans that pass always
stay; a wider span is added if it passes, reaches its threshold and overlaps neither a base
span nor a better added one.

Places are running sums in blocks of ``BLOCK`` matches, and overlaps are looked up by place, so
that texts of very many matches take nearly linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: leftmost matches as of the plain patterns; starts inside a run that failed as a whole are
#: passed over and loops don't back up, so long runs take linear time
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r" ?[\[(] ?(?:at|@) ?[\])] ?", r" ?(?:\.|[\[(] ?(?:dot|\.) ?[\])]) ?"
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[._/]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: a text without this cannot hold a match
NEEDS = {"email": r"@|[\[(] ?at ?[\])]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]|[0-9]{3}"}
CUES = r"(?i)(?:mail|contact|write|phone|call|tel|fax|mobile|card|visa|credit|payment|ip|host|server|address)\W*$"
CONTEXT = 24
#: what stands before an identifier, a price, a date or a version
OTHER = r"(?i)(?:(?<![\p{L}\p{N}])(?:v|ver|version|build|no|nr|id|ids|sku|isbn|order|invoice|ref|serial|date|price|cost|total)\W{0,3}|[$€£#=_/\\])$"
LABEL = r"[A-Za-z]+ ?[:=#] ?$"
FEATURES = ("kind", "plus", "separators", "brackets", "before", "after", "other", "numeric", "line", "crowded", "variety")
ROUNDS, RATE, PRECISION, LEAF_PRIOR, SHRINK = 24, 0.4, 0.9, 1.0, 4.0
#: matches whose places are summed together; characters of an index entry; spans of a text whose pieces are cut one by one
BLOCK, STRIDE, FEW = 512, 256, 64

_SPAN = "struct<kind:int,base:boolean,start:int,end:int,txt:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, value, combine, zero: int = 0) -> Column:
    """For each item the combined values of those before it."""

    def before(some, start, of):
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(some, first, add)["out"]

    def in_blocks(parts):
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), lambda a, x: combine(a, value(x))))
        return F.flatten(F.zip_with(parts, before(totals, F.lit(zero), lambda x: x), lambda p, at: before(p, at, value)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
    return _let(F.transform(starts, lambda i: F.slice(items, i, BLOCK)), in_blocks)


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.split(F.reverse(digits), "")

    def add(total, d):
        twice = d.cast("int") * (F.pmod(total["i"], F.lit(2)) + 1)
        return F.struct((total["i"] + 1).alias("i"), (total["s"] + F.when(twice > 9, twice - 9).otherwise(twice)).alias("s"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"))
    return F.aggregate(F.filter(reverse, lambda d: d != ""), start, add)["s"] % 10 == 0


def _octets(txt: Column) -> Column:
    parts = F.split(F.regexp_replace(txt, r"[^0-9]+", "."), r"\.")
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))


def passes(kind: Column, txt: Column) -> Column:
    """The exact check of a base match."""
    n = F.length(_digits(txt))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, _octets(txt))
        .when(kind == 2, n.between(13, 19) & luhn(_digits(txt)))
        .otherwise(n.between(9, 15))
    )


def valid(kind: Column, base: Column, txt: Column) -> Column:
    """Whether a candidate is a positive: the exact check of its kind, which no feature states."""
    return (
        F.when(kind == 0, F.regexp_replace(txt, r"[\])]", "").rlike("[A-Za-z]{2,}$"))
        .when((kind == 3) & ~base, _digits(txt).rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
        .otherwise(passes(kind, txt))
    )


def _found(text: Column, kind: int, pattern: str, base: bool) -> Column:
    """Spans of a pattern: lengths of the pieces between the matches give the places."""

    def spans(found):
        def one(x, at):
            hit, gap = x["hit"], x["gap"]
            begin = at + F.length(gap)
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), begin.alias("start"), (begin + F.length(hit)).alias("end"), hit.alias("txt"),
                F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(x["nxt"], 1, 1).alias("after"),
            )

        return F.zip_with(found, running(found, lambda x: F.length(x["gap"]) + F.length(x["hit"]), lambda a, b: a + b), one)

    def matches(both):
        hits, rest = both["hits"], both["rest"]
        n = F.size(hits)
        gaps = F.zip_with(hits, F.slice(rest, 1, n), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.zip_with(gaps, F.slice(rest, 2, n), lambda hg, x: F.struct(hg["hit"].alias("hit"), hg["gap"].alias("gap"), x.alias("nxt")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("rest"))
    got = _let(both, lambda x: _let(matches(x), spans))
    return F.when(text.rlike(NEEDS[KINDS[kind]]) & text.rlike(pattern), got).otherwise(F.array().cast(f"array<{_SPAN}>"))


def proposals(text: Column) -> Column:
    """All proposed spans of a text: base ones and wider ones."""
    return F.concat(*[_found(text, i, p[k], p is BASE) for p in (BASE, WIDE) for i, k in enumerate(KINDS)])


def _side(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)
    )


def span_features(s: Column) -> list[Column]:
    """Binned features of a span, in the order of ``FEATURES``."""
    txt, before = s["txt"], s["before"]
    return [
        s["kind"],
        txt.contains("+").cast("int"),
        F.least(F.lit(3), F.length(F.regexp_replace(txt, r"[^ ().\-_/]", ""))),
        txt.rlike(r"[\[(]").cast("int"),
        _side(F.substring(before, -1, 1)),
        _side(s["after"]),
        before.rlike(OTHER).cast("int"),
        before.rlike("[0-9][^0-9]{0,3}$").cast("int"),
        before.rlike(r"(?:^|\n)[ \t]*$").cast("int"),
        (F.length(before) < CONTEXT).cast("int"),
        (F.size(F.array_distinct(F.split(_digits(txt), ""))) >= 3).cast("int"),
    ]


def evidence(s: Column) -> Column:
    """1 for a span that is personal data by what stands before it, 0 for one inside something else, else null."""
    before, joined = s["before"], r"[\p{L}\p{N}_]"
    inside = before.rlike(joined + "$") | s["after"].rlike("^" + joined) | before.rlike(OTHER)
    return F.when(inside, 0).when(s["base"] | before.rlike(CUES) | before.rlike(LABEL), 1)


class Boosted:
    """An additive model of depth-two trees over binned features, and a threshold for each kind."""

    def __init__(self, bias: float, trees: list, thresholds: list[float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def margin(self, x) -> float:
        return self.bias + sum(self._leaf(t, x) for t in self.trees)

    @staticmethod
    def _leaf(tree, x):
        while isinstance(tree, tuple):
            f, b, yes, no = tree
            tree = yes if x[f] <= b else no
        return tree

    def score(self, x) -> float:
        return 1 / (1 + math.exp(-self.margin(x)))

    def column(self, x: list[Column]) -> Column:
        def as_column(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, b, yes, no = tree
            return F.when(x[f] <= b, as_column(yes)).otherwise(as_column(no))

        total = F.lit(float(self.bias))
        for t in self.trees:
            total = total + as_column(t)
        return 1 / (1 + F.exp(-total))


def boost(patterns: list[tuple[tuple[int, ...], float, float]], held: list) -> Boosted:
    """Fit on (features, n, positives) and calibrate on those of ``held``; one rule for any number of them."""
    n, y = sum(p[1] for p in patterns), sum(p[2] for p in patterns)
    bias = math.log((y + 0.5) / (n - y + 0.5))
    margin = [bias] * len(patterns)
    trees = []

    def leaf(rows, g, h):
        return RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + LEAF_PRIOR)

    def gain(rows, g, h):
        s = sum(g[i] for i in rows)
        return s * s / (sum(h[i] for i in rows) + LEAF_PRIOR)

    def grow(rows, g, h, depth):
        whole, best = gain(rows, g, h), None
        if depth:
            for f in range(len(FEATURES)):
                for b in sorted({patterns[i][0][f] for i in rows})[:-1]:
                    yes = [i for i in rows if patterns[i][0][f] <= b]
                    no = [i for i in rows if patterns[i][0][f] > b]
                    got = gain(yes, g, h) + gain(no, g, h) - whole
                    if got > 1e-6 and (best is None or got > best[0]):
                        best = (got, f, b, yes, no)
        if best is None:
            return leaf(rows, g, h)
        _, f, b, yes, no = best
        return (f, b, grow(yes, g, h, depth - 1), grow(no, g, h, depth - 1))

    for _ in range(ROUNDS if patterns else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [r[2] - r[1] * q for r, q in zip(patterns, p, strict=True)]
        h = [r[1] * q * (1 - q) for r, q in zip(patterns, p, strict=True)]
        tree = grow(list(range(len(patterns))), g, h, 2)
        trees.append(tree)
        margin = [m + Boosted._leaf(tree, r[0]) for m, r in zip(margin, patterns, strict=True)]
    model = Boosted(bias, trees, [])
    model.thresholds = [_threshold([(model.score(x), n, good) for x, n, good in held if x[0] == k and n]) for k in range(len(KINDS))]
    return model


def _threshold(scored: list[tuple[float, float, float]]) -> float:
    """The lowest score t from which (score, n, positives), and ``SHRINK`` spans of precision t, reach ``PRECISION``."""
    tops = sorted({s for s, _, _ in scored})
    for t in sorted({PRECISION, *tops, *([tops[-1] + 1e-6] if tops else [])}):
        seen, right = (sum(r[i] for r in scored if r[0] >= t) for i in (1, 2))
        if right + SHRINK * t >= PRECISION * (seen + SHRINK):
            # sums of floats may differ in the last place where they are taken by columns
            return t - 1e-9
    return 1.1


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of candidates with evidence by half of the texts and feature pattern: (half, f0, f1, ..., n, y), y positives."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    half = F.pmod(F.crc32(text.cast("binary")), F.lit(2)).cast("int").alias("half")
    scored = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "base", "start", "end", "txt", "before", "after")], F.lit(0.0).alias("score"))
    good = lambda s: F.when(s["base"], passes(s["kind"], s["txt"])).otherwise(valid(s["kind"], s["base"], s["txt"]))
    # the half comes first, as a column above the explosion would read the text again for each span; and what
    # says that it may change from row to row is worked out once, not again in filters that are drawn from it
    once = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    spans = docs.select(half, once(F.transform(F.filter(proposals(text), good), scored)).alias("p"))
    spans = spans.select("half", once(_settled(F.col("p"))).alias("p")).select("half", F.explode("p").alias("s"))
    x = [c.cast("int").alias(f"f{i}") for i, c in enumerate(span_features(F.col("s")))]
    names = ["half", *(f"f{i}" for i in range(len(FEATURES)))]
    told = spans.select("half", *x, evidence(F.col("s")).alias("good")).where("good is not null")
    return told.groupBy(*names).agg(F.count("*").alias("n"), F.sum("good").alias("y")).orderBy(*names)


def train(docs: DataFrame, text_col: str = "text") -> Boosted:
    """Trees from the candidates of all texts; what reaches the driver is a row for each feature
    pattern, whose number the bins bound (some hundreds occur)."""
    rows = [(r[0], tuple(r[1 : 1 + len(FEATURES)]), float(r.n), float(r.y)) for r in candidates(docs, text_col).collect()]
    return boost([r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] == 1])


def accepted(text: Column, model: Boosted) -> Column:
    """Accepted spans (kind, start, end, base, score) by kind, then start."""

    def judge(s):
        score = F.when(s["base"], F.lit(1.0)).otherwise(model.column(span_features(s)))
        least = F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), s["kind"] + 1)
        ok = F.when(s["base"], passes(s["kind"], s["txt"])).otherwise((score >= least) & valid(s["kind"], s["base"], s["txt"]))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), score.alias("score"), ok.alias("ok"))

    judged = F.filter(F.transform(proposals(text), judge), lambda s: s["ok"])
    return F.transform(judged, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))


def _indexed(spans: Column, kind: int, base: bool) -> Column:
    """The spans of one kind and origin, which are disjoint and in order, and an index by place: at b the number of
    those that end at or before b * STRIDE."""

    def index(some):
        last = F.transform(some, lambda s: F.floor((s["end"] - 1) / STRIDE).cast("int"))
        steps = F.zip_with(last, F.slice(F.concat(F.array(F.lit(-1)), last), 1, F.size(last)), lambda x, y: x - y)
        reach = F.flatten(F.transform(steps, lambda d, i: F.array_repeat(i, d)))
        return F.struct(some.alias("spans"), reach.alias("reach"))

    return _let(F.filter(spans, lambda s: (s["kind"] == kind) & (s["base"] == F.lit(base))), index)


def _settled(spans: Column) -> Column:
    """Without added spans that overlap a base span or a better added one."""

    def beaten(lists, a):
        def beats(b):
            meet = (b["start"] < a["end"]) & (a["start"] < b["end"])
            better = b["base"] | (b["score"] > a["score"]) | ((b["score"] == a["score"]) & ((b["kind"] < a["kind"]) | ((b["kind"] == a["kind"]) & (b["start"] < a["start"]))))
            return meet & better

        def near(x):
            """Those that end after the start of ``a``, up to the first that ends after its end."""
            n = F.size(x["spans"])
            low = F.coalesce(F.get(x["reach"], F.floor(a["start"] / STRIDE).cast("int")), n)
            high = F.coalesce(F.get(x["reach"], F.floor((a["end"] - 1) / STRIDE).cast("int") + 1), n)
            return F.slice(x["spans"], low + 1, high - low + 1)

        return F.exists(lists, lambda x: F.exists(near(x), beats))

    lists = F.array(*[_indexed(spans, k, base) for base in (True, False) for k in range(len(KINDS))])
    kept = _let(lists, lambda x: F.filter(spans, lambda a: a["base"] | ~beaten(x, a)))
    return F.when(F.exists(spans, lambda s: ~s["base"]), kept).otherwise(spans)


def with_spans(docs: DataFrame, model: Boosted, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` and a column of accepted spans (kind, start, end, base, score), by kind, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.withColumn(out, accepted(text, model))
    return got.withColumn(out, F.array_sort(_settled(F.col(out))))


def redacted(docs: DataFrame, model: Boosted, text_col: str = "text") -> DataFrame:
    """``docs`` with each accepted span, or run of overlapping ones, replaced by its kind in brackets.

    A null text stays null; texts without accepted spans are unchanged.
    """
    spans = free_name(docs, "_spans")
    got = with_spans(docs, model, text_col, spans)
    text = F.col(text_col)
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    tag = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def written(piece):
        """The text with the tags in place; ``piece`` cuts it between two places."""

        def put(some):
            upto = running(some, lambda s: s["end"], F.greatest)
            parts = F.zip_with(some, upto, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.element_at(tag, s["kind"] + 1))).otherwise(""))
            return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(some, lambda s: s["end"])), F.length(text)))

        return _let(by_place, put)

    few = written(lambda a, b: F.substring(text, a + 1, b - a))
    # characters by place, as each cut of a text reads it from the start
    many = _let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: written(lambda a, b: F.array_join(F.slice(c, a + 1, b - a), "")))
    new = F.when(F.size(spans) == 0, text).when(F.size(spans) <= FEW, few).otherwise(many)
    return got.withColumn(text_col, new).drop(spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row of ``docs``: accepted spans (kind, start, end, base, score).

    Places are code points, ends exclusive.  Null and empty texts have no spans; repeated
    rows have the same ones; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return with_spans(texts, train(texts), "text", "spans").select("id", "spans")


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs).withColumn("b", F.filter("spans", lambda s: s["base"]))
    counts = [F.size(F.filter("b", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_digest(F.col("b")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"), (F.size("spans") - F.size("b")).cast("long").alias("n_added"),
    )
