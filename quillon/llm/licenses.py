"""Licence scans: normalised passages against licence templates by the Dice coefficient.

A text's passages are its lines, the sentences of a line, its paragraphs and the whole.  A
passage and a template are compared as multisets of word bigrams, 2 |A & B| / (|A| + |B|).
For a least value d their sizes differ by a factor of at most (2 - d) / d, so passages go by
their number of words before their bigrams are listed, and the rest meet only templates in
bounds.  A passage that reaches d holds at least ``share`` of a template's bigrams, so it
holds a word of any set of words that touches more than the rest of them: texts without one
of those words are passed over, which loses nothing.  The templates' bigrams are a fixed
table of some hundreds of rows, which is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

#: fixed values: words too common to search for while others serve
COMMON = frozenset("a an and any are as at be by can for from has if in is it its may not of on one or so such that the this to under use was which with you your".split())

#: fixed values: licence notices as their publishers word them
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(templates=TEMPLATES) -> list[tuple[int, str, int, str, int]]:
    """(template, licence, bigrams, bigram, times) of each template."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = _words(text)
        pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        out += [(i, name, len(words) - 1, p, n) for p, n in sorted(pairs.items())]
    return out


def needed_words(least: float = LEAST, templates=TEMPLATES) -> list[str]:
    """Words of which every passage that reaches ``least`` holds one: long words first, as they are rarer, common ones last."""
    share = least * (1 + least / (2 - least)) / 2
    out: set[str] = set()
    for _, text in templates:
        words = _words(text)
        pairs = list(zip(words, words[1:], strict=False))
        spare, chosen = len(pairs) - math.ceil(share * len(pairs) - 1e-9), set()
        for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(a in chosen or b in chosen for a, b in pairs) > spare:
                break
            chosen.add(w)
        out |= chosen
    return sorted(out)


def normalised(text: Column) -> Column:
    """Lower-case words with one space between, line breaks kept, sentence ends within a line as \\x01."""
    text = F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), r"([.!?])[ \t]+", "$1\x01")
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n\x01]+", " ")


def _plain(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, r"[\n\x01 ]+", " "))


def passages(plain: Column, low: float, high: float) -> Column:
    """Distinct passages of a normalised text whose numbers of bigrams are in bounds."""
    lines = F.split(plain, "\n")
    sentences = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("\x01"))), lambda x: F.split(x, "\x01")))
    wide = F.when(plain.rlike(r"\n *\n"), F.split(plain, r"\n *\n")).otherwise(F.array().cast("array<string>"))
    units = F.transform(F.concat(lines, sentences, wide, F.array(plain)), _plain)
    bigrams = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    return F.array_distinct(F.filter(units, lambda u: bigrams(u).between(low, high)))


def runs(paragraph: Column, low: float, high: float, known: list[str], least: float = LEAST) -> Column:
    """Runs of two or more pieces (lines, sentences of a line) of a normalised paragraph whose numbers of bigrams
    are in bounds; those that can't reach ``least``, or only less than a run or piece inside them, may be left out."""
    share, most = least * (1 + least / (2 - least)) / 2, int(high) + 2
    none = F.array().cast("array<string>")

    def described(piece, after):
        """A piece, its words, and how many of the bigrams that begin in it are a template's."""
        words = F.split(F.concat(piece, F.lit(" "), F.substring_index(after, " ", 1)), " ")
        n = F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))) + 1
        pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.struct(piece.alias("t"), n.alias("n"), F.size(F.filter(pairs, lambda p: p.isin(known))).alias("c"))

    def grow(acc, x):
        n, c = acc["n"] + x["n"], acc["c"] + x["c"]
        t = F.when(acc["n"] == 0, x["t"]).otherwise(F.concat(acc["t"], F.lit(" "), x["t"]))
        on = acc["on"] & (n - 1 <= high) & (c >= n * (least / 2) - 1e-9)
        good = (acc["n"] > 0) & (n - 1 >= low) & (c >= (n - 1) * share - 1e-9)
        longer = F.struct(t.alias("t"), n.alias("n"), c.alias("c"), on.alias("on"), F.when(good, F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out"))
        ended = F.struct(acc["t"].alias("t"), acc["n"].alias("n"), acc["c"].alias("c"), F.lit(False).alias("on"), acc["out"].alias("out"))
        return F.when(on, longer).otherwise(ended)

    def from_each(rows):
        start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(True).alias("on"), none.alias("out"))
        begins = lambda x: x["c"] >= x["n"] * (least / 2) - 1e-9
        return F.flatten(F.transform(rows, lambda x, i: F.when(begins(x), F.aggregate(F.slice(rows, i + 1, F.lit(most)), start, grow)["out"]).otherwise(none)))

    def of(pieces):
        after = F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")))
        return F.flatten(F.transform(F.array(F.zip_with(pieces, after, described)), from_each))

    pieces = F.filter(F.transform(F.split(paragraph, r"[\n\x01]"), _plain), lambda x: x != "")
    return F.flatten(F.transform(F.filter(F.array(pieces), lambda p: F.size(p) > 1), of))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(id, license, dice, passages, passage): each licence that a row's text names.

    dice is the best of its passages' values, ``passages`` the number of distinct ones that
    reach ``least``, ``passage`` the first of the best in alphabetical order; they are runs only
where no other passage names the licence.  Null and empty
    texts and texts of one word have none; rows with one id are one set of passages, rows
    with a null id another; other columns are not read.
    """
    spark = docs.sparkSession
    rows = template_bigrams(templates)
    table = spark.createDataFrame(rows, "template int, license string, size int, bigram string, times int")
    bound = (2 - least) / least
    low, high = min(r[2] for r in rows) / bound, max(r[2] for r in rows) * bound
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col).cast("string")).alias("plain"))
    needed = F.array(*[F.lit(w) for w in needed_words(least, templates)])
    text = text.where(F.arrays_overlap(F.split("plain", r"[\n\x01 ]"), needed))
    known = sorted({r[3] for r in rows})
    wide = F.filter(F.split("plain", r"\n *\n"), lambda x: F.arrays_overlap(F.split(x, r"[\n\x01 ]"), needed))
    wide = F.array_distinct(F.flatten(F.transform(wide, lambda x: runs(x, low, high, known, least))))
    tagged = lambda units, run: F.transform(units, lambda u: F.struct(F.lit(run).alias("run"), u.alias("passage")))
    units = text.select("id", F.explode(F.concat(tagged(passages(F.col("plain"), low, high), 0), tagged(wide, 1))).alias("x"))
    units = units.select("id", "x.run", "x.passage").withColumn("words", F.split("passage", " "))
    units = units.where(F.arrays_overlap("words", needed))
    n = F.size("words") - 1
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    units = units.select("id", "run", "passage", n.alias("n"), F.explode(F.array_distinct(F.transform(pairs, lambda p: F.struct(p.alias("bigram"), F.size(F.filter(pairs, lambda q: q == p)).alias("here"))))).alias("x"))
    units = units.select("id", "run", "passage", "n", "x.bigram", "x.here")
    met = units.join(F.broadcast(table), "bigram").where(F.col("n").between(F.col("size") / bound, F.col("size") * bound))
    # repeated rows bring their passages several times: a bigram of a passage counts once
    met = met.groupBy("id", "run", "passage", "n", "template", "license", "size", "bigram").agg(F.least(F.max("here"), F.max("times")).alias("o"))
    both = met.groupBy("id", "run", "passage", "n", "template", "license", "size").agg(F.sum("o").alias("o"))
    dice = both.withColumn("dice", 2.0 * F.col("o") / (F.col("n") + F.col("size"))).where(F.col("dice") >= least)
    found = dice.groupBy("id", "license", "run").agg(
        F.round(F.max("dice"), 9).alias("dice"),
        F.count_distinct("passage").alias("passages"),
        F.min(F.struct((-F.col("dice")).alias("d"), "passage"))["passage"].alias("passage"),
    )
    first = F.min(F.struct("run", "dice", "passages", "passage")).alias("x")
    return found.groupBy("id", "license").agg(first).select("id", "license", "x.dice", "x.passages", "x.passage")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences that ``documents`` name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    rows = ",\n  ".join(f"({i}, '{name}', {n}, '{p}', {t})" for i, name, n, p, t in template_bigrams())
    bound = (2 - LEAST) / LEAST
    return f"""
WITH t(template, license, size, bigram, times) AS (VALUES
  {rows}),
d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(unnest(list_concat(string_split(text, chr(10)),
    string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)),
    string_split_regex(text, '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n'), [text]))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS passage FROM d),
w AS (SELECT *, string_split(passage, ' ') AS words FROM u),
e AS (SELECT doc_id, passage, len(words) - 1 AS n, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram FROM w),
c AS (SELECT doc_id, passage, n, bigram, count(*) AS here FROM e GROUP BY ALL),
m AS (SELECT doc_id, passage, license, 2.0::DOUBLE * sum(least(here, times)) / (n + size) AS dice FROM c JOIN t USING (bigram)
  WHERE n BETWEEN size / CAST({bound} AS DOUBLE) AND size * CAST({bound} AS DOUBLE)
  GROUP BY doc_id, passage, n, template, license, size HAVING 2.0::DOUBLE * sum(least(here, times)) / (n + size) >= {LEAST})
SELECT doc_id, license, round(max(dice), 9) AS dice, count(DISTINCT passage) AS passages, arg_min(passage, (-dice, passage)) AS passage
FROM m GROUP BY doc_id, license
"""


OP3_SQL = _sql()
