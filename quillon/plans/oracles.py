"""DuckDB SQL for the catalogue's queries, over the same tables."""

from __future__ import annotations

from ..functions.text import CJK
from ..operators import correction, prompts
from .catalog import TOP_K

W = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _script(c: str) -> str:
    return f"CASE WHEN {_count(c, chr(92) + 'p{L}')} = 0 THEN 'none' WHEN {_count(c, CJK)} / {_count(c, chr(92) + 'p{L}')} > 0.3 THEN 'cjk' ELSE 'latin' END"


def _sentences(c: str) -> str:
    once = f"regexp_replace({c}, '([。．！？!?]){SPACE}*', '\\1' || chr(1), 'g')"
    twice = f"regexp_replace({once}, '\\.{SPACE}+([A-Z0-9])', '.' || chr(1) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split({twice}, chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{W}')"


def _index(prefix: str = "", src: str = "(SELECT doc_id AS id, text, lang FROM documents)") -> str:
    """CTEs tok, dl, cs, p, df, idf of an index over ``src``."""
    x = prefix
    return f"""{x}dl AS MATERIALIZED (SELECT id, lang, {_words('text')} AS terms, len({_words('text')})::BIGINT AS dl FROM {src}),
{x}cs AS (SELECT count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM {x}dl),
{x}p AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM {x}dl) GROUP BY ALL),
{x}df AS (SELECT term, count(*) AS df FROM {x}p GROUP BY term),
{x}raw AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM {x}df, {x}cs),
{x}idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {x}raw) ELSE raw END AS idf FROM {x}raw)"""


def _search(name: str, asked: str, k: int, prefix: str = "", where: str = "TRUE") -> str:
    """CTEs of a search: <name>s scores, <name> ranked hits (query_id, rank, id, score)."""
    x = prefix
    return f"""{name}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_words('query')}) AS term FROM {asked}) GROUP BY ALL),
{name}s AS (SELECT query_id, p.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM {name}q q JOIN {x}idf i ON i.term = q.term JOIN {x}p p ON p.term = q.term JOIN {x}dl d ON d.id = p.id, {x}cs c WHERE {where} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM {name}s) WHERE rank <= {k})"""


def _tokens(c: str) -> str:
    return f"""CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, round_even({_count(c, CJK)} / 1.1::DOUBLE + (length({c}) - {_count(c, CJK)}) / 4.0::DOUBLE, 0))::INT END"""


LINES = f"""ln AS (SELECT doc_id, lang, unnest(lines) AS line, generate_subscripts(lines, 1) AS li FROM
  (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS lines FROM documents))"""


def _word_tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACE[1:]}+'))::INT"


def _cut(units: str, target: int, overlap: int, tokens=_tokens) -> str:
    """CTEs of windows over units (doc_id, k, head, place, s), of each (doc_id, k) in the order of ``place``: win (doc_id, k, i, head, text)."""
    fits = f"greatest(w.i + 1, len(list_filter(upto, lambda x: x <= upto[w.i + 1] + {target})) - 1)"
    back = f"least(greatest(len(list_filter(upto, lambda x: x <= upto[w.j + 1] - {overlap})), w.i + 1), w.j + 1) - 1"
    return f"""un AS (SELECT *, sum({tokens('s')}) OVER (PARTITION BY doc_id, k ORDER BY place) AS upto FROM {units}),
ul AS MATERIALIZED (SELECT doc_id, k, list(s ORDER BY place) AS s, list(head ORDER BY place) AS head, list_prepend(0, list(upto::BIGINT ORDER BY place)) AS upto, count(*) AS n FROM un GROUP BY ALL),
wn AS (SELECT doc_id, k, 0::BIGINT AS i, {fits.replace('w.i', '0')}::BIGINT AS j FROM ul
  UNION ALL SELECT doc_id, k, i, {fits.replace('w.i', 'y.i')}::BIGINT FROM
    (SELECT w.doc_id, w.k, upto, (CASE WHEN w.j = w.i + 1 THEN w.j ELSE greatest(w.i + 1, {back}) END)::BIGINT AS i FROM wn w JOIN ul ON ul.doc_id = w.doc_id AND ul.k = w.k WHERE w.j < n) y),
win AS (SELECT doc_id, k, i, head[i + 1] AS head, array_to_string(s[i + 1 : j], ' ') AS text FROM wn JOIN ul USING (doc_id, k))"""


def _fixed(target: int, overlap: int, least: int) -> str:
    units = f"(SELECT doc_id, 0 AS k, substring(line, 1, 1) AS head, li * 1000000 + unnest(range(len(ss))) AS place, unnest(ss) AS s FROM (SELECT *, {_sentences('line')} AS ss FROM ln))"
    return f"""{LINES}, {_cut(units, target, overlap)},
pc AS (SELECT doc_id, 'page/' || head AS path, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal FROM win WHERE {_tokens('text')} >= {least})"""


def _structural(target: int, overlap: int, least: int, tokens=_tokens) -> str:
    units = f"(SELECT doc_id, k, path AS head, unnest(range(len(ss))) AS place, unnest(ss) AS s FROM (SELECT *, {_sentences('text')} AS ss FROM ca WHERE NOT small))"
    prefix = "CASE WHEN {a} = {b} THEN {a} ELSE 'page' END"
    text = "CASE WHEN c.small THEN c.text || chr(10) || chr(10) || s.text ELSE s.text END"
    return f"""{LINES},
sg AS (SELECT *, sum((head IS DISTINCT FROM before)::INT) OVER (PARTITION BY doc_id ORDER BY li) AS k FROM
  (SELECT *, substring(line, 1, 1) AS head, lag(substring(line, 1, 1)) OVER (PARTITION BY doc_id ORDER BY li) AS before FROM ln)),
sc AS MATERIALIZED (SELECT doc_id, k::BIGINT AS k, 'page/' || any_value(head) AS path, string_agg(line, chr(10) || chr(10) ORDER BY li) AS text FROM sg GROUP BY doc_id, k),
ca AS (SELECT doc_id, k, path, text, {tokens('text')} < {least} AS small FROM sc WHERE k = 1
  UNION ALL SELECT doc_id, k, path, text, {tokens('text')} < {least} FROM
    (SELECT s.doc_id, s.k, CASE WHEN c.small THEN {prefix.format(a='c.path', b='s.path')} ELSE s.path END AS path, {text} AS text FROM ca c JOIN sc s ON s.doc_id = c.doc_id AND s.k = c.k + 1)),
sr AS (SELECT doc_id, path, text FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS last FROM ca) WHERE k = last AND small),
{_cut(units, target, overlap, tokens)},
wp AS (SELECT doc_id, head AS path, text, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY doc_id) AS n FROM win WHERE {tokens('text')} >= {least} WINDOW w AS (PARTITION BY doc_id ORDER BY k, i)),
pc AS (SELECT wp.doc_id, CASE WHEN ordinal = n - 1 AND sr.doc_id IS NOT NULL THEN {prefix.format(a='wp.path', b='sr.path')} ELSE wp.path END AS path,
    CASE WHEN ordinal = n - 1 AND sr.doc_id IS NOT NULL THEN wp.text || chr(10) || chr(10) || sr.text ELSE wp.text END AS text, ordinal FROM wp LEFT JOIN sr ON sr.doc_id = wp.doc_id
  UNION ALL SELECT doc_id, path, text, 0 FROM sr WHERE doc_id NOT IN (SELECT doc_id FROM wp))"""


def _told(pieces: str, strategy: str, tokens=_tokens) -> str:
    doc = "lang || ':' || doc_id"
    return f"""WITH RECURSIVE {pieces} SELECT substring(sha1({doc} || '|{strategy}|' || ordinal), 1, 16) AS chunk_id, {doc} AS doc_id, path, md5(pc.text) AS text_md5,
  {tokens('pc.text')} AS token_count, length(pc.text)::INT AS char_count, ordinal::INT AS ordinal FROM pc JOIN documents USING (doc_id)"""


def _manifest(pieces: str) -> str:
    return f"""WITH RECURSIVE {pieces}, ch AS (SELECT lang, doc_id, {_tokens('pc.text')} AS t FROM pc JOIN documents USING (doc_id)),
by_ AS (SELECT lang, count(*) AS n, round(avg(t), 1) AS mean FROM ch GROUP BY lang)
SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM ch) AS chunks_total, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ch)) AS documents_yielding_no_chunks,
  (SELECT '{{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}}' FROM by_) AS by_lang, (SELECT '{{' || string_agg('"' || lang || '":' || mean, ',' ORDER BY lang) || '}}' FROM by_) AS mean_tokens,
  'structural' AS strategy, 'heuristic' AS tokenizer"""


ASKED = "(SELECT item_id AS query_id, text AS query FROM benchmark)"
HITS = "SELECT query_id, rank, id AS doc_id, round(score, 6) AS score FROM h"
COVER = """cv AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM
  (SELECT query_id, p.id, count(*)::DOUBLE AS score FROM hq q JOIN p ON p.term = q.term GROUP BY ALL)) WHERE rank <= {k})"""
GOLD = """gold AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'ja' END AS lang,
  coalesce((SELECT list(DISTINCT doc_id) FROM documents d WHERE contains(d.text, b.text)), []) AS relevant FROM benchmark b)"""


def _items(name: str, hits: str) -> str:
    """CTE of item metrics of ``hits`` against gold."""
    return f"""{name} AS (SELECT g.query_id, g.lang, len(g.relevant) > 0 AS answerable,
  {', '.join(f"CASE WHEN len(g.relevant) > 0 THEN coalesce((min(rank) <= {k})::INT::DOUBLE, 0.0) END AS recall_at_{k}" for k in (1, 3, 5, 10))},
  CASE WHEN len(g.relevant) > 0 THEN coalesce(1.0 / min(rank), 0.0) END AS rr,
  CASE WHEN len(g.relevant) > 0 THEN coalesce(sum(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) END), 0.0)
    / list_sum(list_transform(range(1, least(len(g.relevant), 10) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS ndcg
  FROM gold g LEFT JOIN {hits} h ON h.query_id = g.query_id AND list_contains(g.relevant, h.id) GROUP BY g.query_id, g.lang, g.relevant)"""


METRICS = "recall_at_1 recall_at_3 recall_at_5 recall_at_10 rr ndcg".split()


def _report(items: str) -> str:
    means = ", ".join(f"avg({m}) AS {'mrr' if m == 'rr' else m}" for m in METRICS)
    return f"SELECT lang, count(*) AS n_items, count(*) FILTER (answerable) AS n_answerable, {means} FROM {items} GROUP BY ROLLUP (lang)"


def _round(sql: str, columns: list[str], rest: str) -> str:
    return f"SELECT {rest}, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM ({sql})"


MEANS = [("mrr" if m == "rr" else m) for m in METRICS]
MATRIX = r"""mx AS (SELECT true_label, predicted_label, count(*) AS n FROM (
  SELECT CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS true_label,
    CASE WHEN len(regexp_extract_all(text, '[^\p{L}\p{N}\s\x0B]')) * 10 >= length(text) THEN 'unsupported' ELSE 'supported' END AS predicted_label
  FROM documents JOIN labels USING (doc_id)) GROUP BY ALL),
lb AS (SELECT unnest(['supported', 'unsupported', 'contradicted']) AS l),
matrix AS (SELECT a.l AS true_label, b.l AS predicted_label, coalesce(n, 0) AS n FROM lb a CROSS JOIN lb b LEFT JOIN mx ON true_label = a.l AND predicted_label = b.l),
lm AS (SELECT l AS label, sum(n) FILTER (true_label = l AND predicted_label = l) / nullif(sum(n) FILTER (predicted_label = l), 0) AS precision,
  sum(n) FILTER (true_label = l AND predicted_label = l) / nullif(sum(n) FILTER (true_label = l), 0) AS recall,
  sum(n) FILTER (true_label = l)::BIGINT AS support, coalesce(sum(n) FILTER (true_label = predicted_label) / nullif(sum(n), 0), 0.0) AS accuracy FROM lb, matrix GROUP BY l)"""


def _answered(turns: str) -> str:
    """CTEs a, ev and cl: answers, the user's turns of their conversations, and their claims."""
    return f"""a AS ({turns}),
ev AS (SELECT answer_id, turn::INT AS evidence_index, min(c.text) AS evidence FROM a JOIN conversations c USING (conv_id) WHERE role = 'user' GROUP BY ALL),
cl AS (SELECT answer_id, unnest(range(len(s)))::INT AS claim_index, unnest(s) AS claim FROM (SELECT answer_id, {_sentences('text')} AS s FROM a))"""


ANSWERS = _answered("SELECT conv_id * 1000 + turn AS answer_id, conv_id, text FROM conversations WHERE role = 'assistant'")
QUESTIONED = _answered("""SELECT c.conv_id * 1000 + c.turn AS answer_id, c.conv_id, question, c.text FROM conversations c ASOF LEFT JOIN
  (SELECT conv_id, turn, min(text) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY ALL) u ON u.conv_id = c.conv_id AND c.turn > u.turn WHERE c.role = 'assistant'""")


def _lexical(name: str, claims: str, evidence: str) -> str:
    return f"""{name}c AS (SELECT answer_id, claim_index, claim, list_distinct({_words('claim')}) AS terms FROM {claims}),
{name}x AS (SELECT answer_id, claim_index, evidence_index, len(list_intersect(terms, list_distinct({_words('evidence')})))::DOUBLE / nullif(len(terms), 0) AS score
  FROM {name}c JOIN {evidence} USING (answer_id)),
{name}b AS (SELECT answer_id, claim_index, max(score) AS score, arg_min(evidence_index, (-score, evidence_index)) AS best FROM {name}x WHERE score > 0 GROUP BY ALL),
{name} AS (SELECT c.answer_id, c.claim_index, claim, CASE WHEN score >= 0.6 THEN 'supported' ELSE 'unsupported' END AS label, coalesce(score, 0.0) AS score,
  best AS best_evidence_index, 'lexical-overlap' AS method FROM {name}c c LEFT JOIN {name}b b ON b.answer_id = c.answer_id AND b.claim_index = c.claim_index)"""


def _decided(answers: str, index: str, x: str, held: str, asked: str = "text") -> str:
    """CTEs dec and cor: claims of ``answers`` verified, looked up again in index ``x`` of the table ``held``, and corrected."""
    return f"""{answers}, {_lexical('v', 'cl', 'ev')},
{index}ask AS (SELECT answer_id || '#' || claim_index AS query_id, claim AS query FROM v WHERE label = 'unsupported'),
{_search('rh', 'ask', 3, x)},
rcl AS (SELECT query_id AS answer_id, 0 AS claim_index, query AS claim FROM ask),
rev AS (SELECT query_id AS answer_id, rank - 1 AS evidence_index, text AS evidence FROM rh JOIN {held} ON held_id = id),
{_lexical('rv', 'rcl', 'rev')},
dec AS (SELECT v.*, CASE WHEN v.label = 'supported' THEN 'kept' WHEN rv.label = 'supported' THEN 'recovered' ELSE 'struck' END AS action,
  CASE WHEN v.label <> 'supported' AND rv.label = 'supported' THEN rv.label ELSE v.label END AS final_label,
  CASE WHEN v.label <> 'supported' AND rv.label = 'supported' THEN rv.score ELSE v.score END AS final_score,
  CASE WHEN v.label <> 'supported' AND rv.label = 'supported' THEN rv.best_evidence_index ELSE v.best_evidence_index END AS final_best_evidence_index
  FROM v LEFT JOIN rv ON rv.answer_id = v.answer_id || '#' || v.claim_index AND v.label = 'unsupported'),
fin AS (SELECT a.answer_id, a.text, a.{asked} AS asked, count(action) AS n, count(*) FILTER (action <> 'struck') AS k,
  string_agg(claim, ' ' ORDER BY claim_index) FILTER (action <> 'struck') AS kept FROM a LEFT JOIN dec USING (answer_id) GROUP BY a.answer_id, a.text, a.{asked}),
cor AS (SELECT answer_id, CASE WHEN n = 0 THEN text WHEN k = 0 OR k / n < 0.5 THEN
    CASE WHEN {_script('asked')} = 'cjk' THEN '{correction.REFUSAL_JA}' ELSE '{correction.REFUSAL_EN.replace("'", "''")}' END ELSE kept END AS final_text,
  n > 0 AND (k = 0 OR k / n < 0.5) AS refused,
  CASE WHEN n > 0 AND (k = 0 OR k / n < 0.5) THEN 'only ' || k || '/' || n || ' claims verified against the retrieved sources (or a claim-targeted retry)' END AS refusal_reason,
  n AS n_claims, k AS n_kept FROM fin)"""


PASSAGES = _index("r", "(SELECT item_id AS id, text, 'en' AS lang FROM benchmark)") + ",\n", "r", "(SELECT item_id AS held_id, text FROM benchmark)"
DECIDED = _decided(ANSWERS, *PASSAGES)
PROMPTS = f"""b AS (SELECT h.query_id, string_agg('[' || rank || '] (' || source || ' › ' || d.lang || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) AS sources
  FROM h JOIN documents d ON d.doc_id = h.id GROUP BY h.query_id),
pr AS (SELECT item_id AS query_id, text AS question, '{prompts.SYSTEM_PREAMBLE}' || chr(10) || chr(10) || CASE WHEN sources IS NULL THEN '{prompts.NO_SOURCES.replace("'", "''")}' ELSE 'Sources:' || chr(10) || sources END
  || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark LEFT JOIN b ON query_id = item_id)"""
ECHO = "'[ECHO — no model called. Prompt was ' || length(prompt) || ' chars.]'"
ASK = f"""a AS (SELECT query_id::VARCHAR AS answer_id, question, {ECHO} AS text FROM pr),
ev AS (SELECT h.query_id::VARCHAR AS answer_id, (rank - 1)::INT AS evidence_index, d.text AS evidence FROM h JOIN documents d ON d.doc_id = h.id),
cl AS (SELECT answer_id, unnest(range(len(s)))::INT AS claim_index, unnest(s) AS claim FROM (SELECT answer_id, {_sentences('text')} AS s FROM a))"""

NEAR = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, v.vec_id, list_cosine_similarity(q.e, v.embedding::DOUBLE[]) AS score FROM q, embeddings v WHERE {where}),
h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {tie}) AS rank, vec_id, round(score, 6) AS score FROM s)
SELECT * FROM h WHERE rank <= {k}"""

URL = r"'^[a-z]+://[^/]+/([^/]+)/([0-9]+)'"

_KEEP = """starts_with(rel, 'docs/') AND ends_with(rel, '.md') AND NOT ends_with(rel, '/_index.md') AND NOT contains('/' || rel, '/includes/')
  AND NOT contains('/' || rel, '/_common-resources/') AND NOT contains('/' || rel, '/glossary/') AND NOT starts_with(rel, 'docs/contribute/') AND NOT starts_with(rel, 'docs/test/')"""

def _replaced(c: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', {by}, 'g')"
    return c


def _page_sections() -> str:
    """Blocks of web pages: the lines between headings, under the headings that no later one of their level or above has ended."""
    nl, heading = "chr(10)", r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    body = _replaced("html", *[(rf"(?is)<{t}\b.*?</{t}\s*>", "' '") for t in "script style nav footer header aside form".split()], ("(?s)<!--.*?-->", "' '"), (r"(?is)^.*?<body\b[^>]*>", "''"), (r"\s+", "' '"))
    body = _replaced(body, *[(rf"(?i)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", rf"{nl} || '{'#' * n} \1' || {nl}") for n in range(1, 7)])
    body = _replaced(body, (r"(?i)</?(?:p|div|li|ul|ol|tr|table|br|section|article|blockquote|pre)\b[^>]*>", f"{nl} || {nl}"), ("<[^>]+>", "''"))
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        body = f"replace({body}, '{entity}', {char})"
    body = f"regexp_replace({_replaced(body, (r'(?m)^[ ' + chr(92) + 't]+|[ ' + chr(92) + 't]+$', chr(39) * 2))}, '\\n\\z', '')"
    clean = lambda c: _replaced(c, ("(?s)<!--.*?-->", "''"), (r"!\[[^\]]*\]\([^)]*\)", "''"), (r"\[([^\]]+)\]\([^)]*\)", r"'\1'"), (r"(?i)</?(?:br|hr|img|div|span|p|a|b|i|em|strong)\b[^>]*/?>", "''"))
    title = _strip(_replaced(clean(f"regexp_extract(line, '{heading}', 2)"), (r"\s*\{#[^}]*\}\s*$", "''")))
    joined = _strip(_replaced(clean(f"string_agg(line, {nl} ORDER BY li)"), (r"\n{3,}", f"{nl} || {nl}")))
    return f"""WITH ls AS (SELECT page_id, string_split({body}, {nl}) AS lines FROM pages),
ln AS (SELECT page_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS li FROM ls),
hd AS (SELECT *, length(regexp_extract(line, '{heading}', 1)) AS level, {title} AS title FROM ln),
bk AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY page_id ORDER BY li) AS k FROM hd),
hh AS (SELECT h.page_id, h.k, h.level, h.title, min(g.k) AS gone FROM (SELECT * FROM bk WHERE level > 0) h LEFT JOIN (SELECT * FROM bk WHERE level > 0) g ON g.page_id = h.page_id AND g.k > h.k AND g.level <= h.level GROUP BY ALL),
tx AS (SELECT page_id, k, {joined} AS text FROM bk WHERE level = 0 GROUP BY page_id, k),
st AS (SELECT tx.page_id, tx.k, string_agg(title, ' › ' ORDER BY hh.k) AS path FROM tx JOIN hh ON hh.page_id = tx.page_id AND hh.k <= tx.k AND (gone IS NULL OR gone > tx.k) WHERE title <> '' GROUP BY ALL)
SELECT tx.page_id, (row_number() OVER (PARTITION BY tx.page_id ORDER BY tx.k) - 1)::INT AS idx, coalesce(path, '') AS path, text FROM tx LEFT JOIN st ON st.page_id = tx.page_id AND st.k = tx.k WHERE text <> ''"""


SQL = {
    "page_sections": _page_sections(),
    "script_of_documents": f"SELECT doc_id, {_script('text')} AS script FROM documents",
    "token_count_heuristic": f"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even({_count('text', CJK)} / 1.1::DOUBLE
        + (length(text) - {_count('text', CJK)}) / 4.0::DOUBLE, 0))::INT END AS token_count FROM documents""",
    "sentence_split": f"SELECT doc_id, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
    "word_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_words('text')}) AS term FROM documents) GROUP BY term",
    "char_bigram_terms": f"""SELECT term, count(*) AS n FROM (SELECT unnest(CASE WHEN len(c) < 2 THEN c ELSE list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2]) END) AS term
        FROM (SELECT string_split(regexp_replace(text, '{SPACE}+', '', 'g'), '') AS c FROM documents)) WHERE term <> '' GROUP BY ALL""",
    "segment_dispatch": f"SELECT doc_id, CASE WHEN {_script('text')} = 'cjk' THEN 'ja' ELSE 'en' END AS segmenter, len({_words('text')})::INT AS n_terms FROM documents",
    "clean_inline_pages": f"""SELECT page_id, {_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?i)</?(?:br|hr|img|div|span|p|a|b|i|em|strong)\b[^>]*/?>', '', 'g')")} AS cleaned FROM pages""",
    "page_titles": f"""SELECT page_id, {_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading FROM pages""",
    "url_to_parallel_id": f"SELECT page_id, regexp_extract(url, {URL}, 1) AS lang, 'docs/' || regexp_extract(url, {URL}, 2) || '.md' AS parallel_id FROM pages",
    "path_keep_filter": f"""SELECT page_id, rel, {_KEEP} AND NOT starts_with(rel, 'docs/reference/') AS kept, {_KEEP} AS kept_with_reference FROM (SELECT page_id,
        'docs/' || ['concepts', 'reference', 'contribute', 'test', 'glossary', 'tasks/includes', 'setup'][page_id % 7 + 1] || '/' ||
        CASE WHEN page_id % 5 = 0 THEN '_index.md' WHEN page_id % 11 = 0 THEN 'page.html' ELSE regexp_extract(url, {URL}, 2) || '.md' END AS rel FROM pages)""",
    "corpus_stats_parallel": f"""WITH s AS (SELECT regexp_extract(url, {URL}, 2)::BIGINT % 50 AS pid, bool_or(regexp_extract(url, {URL}, 1) = 'en') AS en, bool_or(regexp_extract(url, {URL}, 1) <> 'en') AS ja FROM pages GROUP BY 1)
        SELECT count(*) FILTER (en) AS en_pages, count(*) FILTER (ja) AS ja_pages, count(*) FILTER (en AND ja) AS parallel_pages, count(*) FILTER (en AND NOT ja) AS en_only_pages, 'sha' AS commit_sha FROM s""",
    "chunk_ids": """SELECT doc_id, substring(sha1(lang || ':' || doc_id || '|structural|0'), 1, 16) AS chunk_id,
        (('0x' || substring(sha1(lang || ':' || doc_id || '|structural|0'), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT AS point_id FROM documents""",
    "heading_trails": "SELECT doc_id, md5(source || ' › ' || lang || chr(10) || chr(10) || text) AS embedded_md5 FROM documents",
    "postings": f"WITH {_index()} SELECT id AS doc_id, term, tf FROM p",
    "doc_lengths_avgdl": f"WITH {_index()} SELECT id AS doc_id, dl, n_docs, round(avgdl, 6) AS avgdl FROM dl, cs",
    "idf_epsilon_floor": f"WITH {_index()} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_candidates": f"WITH {_index()}, {_search('h', ASKED, TOP_K)} SELECT query_id, count(DISTINCT id) AS n_candidates FROM hq JOIN p USING (term) GROUP BY query_id",
    "bm25_topk": f"WITH {_index()}, {_search('h', ASKED, TOP_K)} {HITS}",
    "bm25_block_topk": f"WITH {_index()}, {_search('h', ASKED, TOP_K)} {HITS}",
    "bm25_topk_lang_filtered": f"WITH {_index()}, {_search('h', ASKED, TOP_K, where='lang = CASE WHEN query_id % 2 = 0 THEN ' + chr(39) + 'en' + chr(39) + ' ELSE ' + chr(39) + 'fr' + chr(39) + ' END')} {HITS}",
    "bm25_duplicate_query_terms": f"WITH {_index()}, {_search('h', '(SELECT item_id AS query_id, text || chr(32) || regexp_extract(text, ' + chr(39) + '^[^ \\t\\n\\r]+' + chr(39) + ') AS query FROM benchmark)', TOP_K)} {HITS}",
    "bm25_topk_filled": f"""WITH {_index()}, one AS (SELECT item_id AS query_id, regexp_extract(text, '([^ \\t\\n\\r]+)[ \\t\\n\\r]*$', 1) AS query FROM benchmark), {_search('g', 'one', TOP_K)}
        SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score FROM
        (SELECT o.query_id, dl.id AS doc_id, coalesce(score, 0.0) AS score FROM one o CROSS JOIN dl LEFT JOIN gs ON gs.query_id = o.query_id AND gs.id = dl.id)) WHERE rank <= {TOP_K}""",
    "dense_cosine_topk": "WITH " + NEAR.format(where="TRUE", k=TOP_K, tie="vec_id::VARCHAR"),
    "dense_cosine_topk_filtered": "WITH " + NEAR.format(where="v.label = q.label", k=TOP_K, tie="vec_id::VARCHAR"),
    "rrf_hybrid_topk": f"""WITH {_index()}, {_search('h', ASKED, 50)}, {COVER.format(k=50)}
        SELECT query_id, rank, id AS doc_id, round(score, 6) AS score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM
        (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM h UNION ALL SELECT query_id, id, rank FROM cv) GROUP BY ALL)) WHERE rank <= {TOP_K}""",
    "rerank_two_phase": f"""WITH {_index()}, {_search('h', ASKED, 20)}, c AS (SELECT h.query_id, h.id, len(list_intersect(list_distinct({_words('b.text')}), list_distinct({_words('d.text')})))::DOUBLE
        / nullif(len(list_distinct({_words('b.text')})), 0) AS score FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id)
        SELECT query_id, rank, id AS doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM c) WHERE rank <= 5""",
    "payload_join": f"WITH {_index()}, {_search('h', ASKED, 3)} SELECT query_id, rank, doc_id, d.lang, source FROM h JOIN documents d ON d.doc_id = h.id",
    "page_dedupe_ranking": f"""WITH {_index()}, {_search('h', ASKED, TOP_K)}, b AS (SELECT query_id, source AS page_id, min(rank) AS r FROM h JOIN documents ON doc_id = id GROUP BY ALL)
        SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY r, page_id) AS pos FROM b""",
    "item_metrics": f"WITH {_index()}, {_search('h', ASKED, TOP_K)}, {GOLD}, {_items('it', 'h')} " + _round("SELECT * FROM it", METRICS, "query_id, lang, answerable"),
    "recall_mrr_ndcg": f"WITH {_index()}, {_search('h', ASKED, TOP_K)}, {GOLD}, {_items('it', 'h')} " + _round(_report("it"), MEANS, "lang, n_items, n_answerable"),
    "ablation_table": f"WITH {_index()}, {_search('h', ASKED, TOP_K)}, {COVER.format(k=TOP_K)}, {GOLD}, {_items('it', 'h')}, {_items('ic', 'cv')} "
    + _round(f"SELECT 'bm25' AS arm, * FROM ({_report('it')}) UNION ALL SELECT 'coverage', * FROM ({_report('ic')})", MEANS, "arm, lang, n_items, n_answerable"),
    "backend_parity": f"""WITH {_index()}, {_search('h', ASKED, TOP_K)}, {COVER.format(k=TOP_K)} SELECT count(*) AS queries, count(*) FILTER (x.id IS DISTINCT FROM y.id) AS top1_differs
        FROM (SELECT * FROM h WHERE rank = 1) x FULL JOIN (SELECT * FROM cv WHERE rank = 1) y USING (query_id)""",
    "eval_gate": f"""WITH {_index()}, {_search('h', ASKED, TOP_K)}, {GOLD}, {_items('it', 'h')}, {MATRIX}, m AS (SELECT 'bm25_recall_at_5' AS metric, avg(recall_at_5) AS value, 0.8::DOUBLE AS floor FROM it
        UNION ALL SELECT 'lexical_faithfulness_accuracy', any_value(accuracy), 0.55 FROM lm) SELECT metric, round(value, 6) AS value, floor, coalesce(value >= floor, FALSE) AS ok FROM m""",
    "gold_validation": f"""WITH {GOLD}, g AS (SELECT query_id::VARCHAR AS id, relevant, len(relevant) > 0 OR query_id % 7 = 0 AS answerable FROM gold)
        SELECT id, 'duplicate id' AS problem FROM g WHERE id IN ('0', '1', '2') UNION SELECT id, 'answerable without relevant pages' FROM g WHERE answerable AND len(relevant) = 0
        UNION SELECT id, 'no page ' || r FROM (SELECT id, unnest(relevant) AS r FROM g) WHERE r NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""",
    "confusion_matrix": f"WITH {MATRIX} SELECT true_label, predicted_label, n FROM matrix",
    "label_precision_recall": f"WITH {MATRIX} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(accuracy, 6) AS accuracy FROM lm",
    "decompose_claims": f"WITH {ANSWERS} SELECT * FROM cl",
    "claim_list_lines": f"""WITH {ANSWERS}, j AS (SELECT answer_id, claim_index, regexp_replace(line, '^[ \\-*\\t]+|[ \\-*\\t]+$', '', 'g') AS claim FROM
        (SELECT answer_id, unnest(range(len(s))) AS claim_index, unnest(s) AS line FROM (SELECT answer_id, string_split(array_to_string(list_transform({_sentences('text')}, lambda x: '- ' || x), chr(10)), chr(10)) AS s FROM a)))
        SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY claim_index) - 1)::INT AS claim_index, claim FROM j WHERE {_strip('claim')} <> ''""",
    "lexical_verify_claims": f"WITH {ANSWERS}, {_lexical('v', 'cl', 'ev')} SELECT answer_id, claim_index, claim, label, round(score, 6) AS score, best_evidence_index, method FROM v",
    "faithfulness_rate": f"""WITH {ANSWERS}, {_lexical('v', 'cl', 'ev')} SELECT answer_id, count(label) AS n_claims, round(avg((label = 'supported')::INT), 6) AS faithfulness_rate FROM a LEFT JOIN v USING (answer_id) GROUP BY answer_id""",
    "embedding_verify": """WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
        x AS (SELECT c.vec_id, (10 - (c.vec_id - e.vec_id))::INT AS i, list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM c JOIN embeddings e ON e.vec_id BETWEEN c.vec_id - 10 AND c.vec_id - 1),
        b AS (SELECT vec_id, max(s) AS s, arg_min(i, (-s, i)) AS i FROM x GROUP BY vec_id)
        SELECT c.vec_id AS answer_id, 0 AS claim_index, c.vec_id::VARCHAR AS claim, CASE WHEN s >= 0.85 THEN 'supported' ELSE 'unsupported' END AS label, round(coalesce(s, 0.0), 6) AS score,
        i AS best_evidence_index, 'embedding-sim:given' AS method FROM c LEFT JOIN b USING (vec_id)""",
    "nli_decision_rule": """WITH p AS (SELECT event_id // 3 AS a, (event_id % 3)::INT AS i, abs(round(value * 1000)::BIGINT) % 1001 / 1000.0::DOUBLE AS e FROM events),
        b AS (SELECT a, max(e) AS e, arg_min(i, (-e, i)) AS i FROM p GROUP BY a)
        SELECT a AS answer_id, 0 AS claim_index, (a * 3)::VARCHAR AS claim, CASE WHEN e >= 0.5 THEN 'supported' WHEN 1 - e >= 0.5 THEN 'contradicted' ELSE 'unsupported' END AS label,
        round(e, 6) AS score, i AS best_evidence_index, 'nli:given' AS method FROM b WHERE EXISTS (SELECT 1 FROM events WHERE event_id = a * 3)""",
    "judge_label_parse": """SELECT conv_id, turn, CASE WHEN contains(r, 'CONTRADICT') THEN 'contradicted' WHEN contains(r, 'UNSUPPORTED') THEN 'unsupported' WHEN contains(r, 'SUPPORTED') THEN 'supported' ELSE 'unsupported' END AS label
        FROM (SELECT conv_id, turn, upper(['Supported.', ' unsupported', 'CONTRADICTED by [1]', '[ECHO]', 'It is not supported', 'UNSUPPORTED, not SUPPORTED'][conv_id % 6 + 1]) AS r FROM conversations)""",
    "correction_decisions": f"WITH {DECIDED} SELECT answer_id, claim_index, claim, label, round(score, 6) AS score, best_evidence_index, action, final_label, round(final_score, 6) AS final_score, final_best_evidence_index FROM dec",
    "corrected_answers": f"WITH {_decided(QUESTIONED, *PASSAGES, 'question')} SELECT * FROM cor",
    "refusal_rates": f"""WITH {DECIDED} SELECT round(avg(refused::INT) FILTER (answer_id % 4 <> 0), 6) AS false_refusal_rate, round(avg((NOT refused)::INT) FILTER (answer_id % 4 = 0), 6) AS miss_rate,
        count(*) FILTER (answer_id % 4 <> 0) AS n_answerable, count(*) FILTER (answer_id % 4 = 0) AS n_unanswerable FROM cor""",
    "grounded_prompts": f"""WITH {_index()}, {_search('h', ASKED, 3)}, {PROMPTS}
        SELECT query_id, length(prompt)::INT AS n_chars, md5(prompt) AS prompt_md5, {ECHO} AS answer FROM pr""",
    "asked_answers": f"""WITH {_index()}, {_search('h', ASKED, 3)}, {PROMPTS}, {_decided(ASK, "", "", "(SELECT doc_id AS held_id, text FROM documents)", "question")},
        top AS (SELECT query_id::VARCHAR AS answer_id, count(*)::INT AS n_retrieved, arg_min(id, rank)::VARCHAR AS first_id FROM h GROUP BY query_id)
        SELECT cor.answer_id AS trace_id, question, a.text AS answer_text, coalesce(n_retrieved, 0) AS n_retrieved, first_id, n_claims::INT AS n_claims, n_kept::INT AS n_kept, final_text, refused, refusal_reason
        FROM cor JOIN a USING (answer_id) LEFT JOIN top USING (answer_id)""",
    "refusal_windows": """SELECT (floor((conv_id * 60 + turn + 0.25) / 600) * 600)::BIGINT AS start_s, count(*) AS n, count(*) FILTER (length(text) % 3 = 0) AS refused,
        round(count(*) FILTER (length(text) % 3 = 0)::DOUBLE / count(*), 6) AS refusal_rate FROM conversations WHERE role = 'assistant' GROUP BY 1""",
    "report_deltas": f"""WITH {_index()}, {_search('h', ASKED, TOP_K)}, {COVER.format(k=TOP_K)}, {GOLD}, {_items('it', 'h')}, {_items('ic', 'cv')},
        x AS ({_report('it')}), y AS ({_report('ic')}) SELECT x.lang, '2024-05-01T00:00:00Z' AS previous_at, '2024-05-02T00:00:00Z' AS generated_at,
        {', '.join(f"round(y.{m} - x.{m}, 6) AS {m}_delta" for m in MEANS)} FROM x JOIN y ON x.lang IS NOT DISTINCT FROM y.lang""",
    "structural_chunks_by_words": _told(_structural(90, 20, 12, _word_tokens), "structural", _word_tokens),
    "front_matter_map": """SELECT doc_id, doc_id % 5 <> 0 AS has_map, CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR END AS weight, CASE WHEN doc_id % 5 <> 0 THEN 'it''s ' || source || ' "' || lang || '"' END AS title,
        CASE WHEN doc_id % 5 <> 0 THEN '["' || lang || '", "a, b", "' || source || '"]' END AS tags, CASE WHEN doc_id % 5 <> 0 THEN 'about ' || source || ' and more' || chr(10) || 'end' || chr(10) END AS summary,
        CASE WHEN doc_id % 5 <> 0 THEN lang || ' team' END AS owner, CASE WHEN doc_id % 5 <> 0 THEN '["/' || doc_id || '", "/' || source || '"]' END AS aliases, md5(text) AS body_md5 FROM documents""",
    "trace_roundtrip": """SELECT conv_id || '-' || turn AS trace_id, text AS question, length(text) % 3 = 0 AS refused, conv_id * 60 + turn + 0.25::DOUBLE AS timestamp, 1 AS n_claims,
        round(length(text) * 1.5::DOUBLE, 3) AS total_ms FROM conversations WHERE role = 'assistant'""",
    "fixed_chunks": _told(_fixed(128, 32, 16), "fixed"),
    "chunk_roundtrip": _told(_fixed(128, 32, 16), "fixed"),
    "structural_chunks": _told(_structural(128, 32, 16), "structural"),
    "chunk_manifest": _manifest(_structural(512, 64, 32)),
    "stored_index_topk": f"WITH {_index()}, {_search('h', ASKED, TOP_K)} {HITS}",
    "stored_backend_parity": f"WITH {_index()}, {_search('h', ASKED, TOP_K)} SELECT count(DISTINCT query_id) AS queries, 0 AS top1_differs, 0.0::DOUBLE AS recall_at_5_delta, 0.0::DOUBLE AS mrr_delta FROM h",
    "stored_index_versions": f"""WITH {_index()} SELECT v::BIGINT AS version, count(*) AS n_docs, round(sum(dl) / count(*), 6) AS avgdl, v = 2 AS is_current
        FROM dl, (SELECT unnest([1, 2]) AS v) WHERE v = 2 OR id % 2 = 0 GROUP BY v""",
    "vector_collection_state": """SELECT lang, count(*) AS n, count(*) FILTER (lang = 'en') AS n_new, 32 AS dim, 'fake:32' AS embedder, 16 AS buckets FROM documents GROUP BY lang""",
    "index_count_name": "SELECT lang, count(*) AS n_chunks, (SELECT count(*) FROM documents) AS n_index, 'bm25:char-bigram' AS name FROM documents GROUP BY lang",
    "query_operator_words": f"""SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_words("'NOT \"quoted\" OR * ( - ' || text || ' AND \"\" NEAR not'")}) AS term FROM benchmark) GROUP BY ALL""",
    "vector_upsert": """SELECT doc_id, c AS chunk_id, (('0x' || c)::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT AS point_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS text_md5, 64 AS dim
        FROM (SELECT *, substring(sha1(lang || ':' || doc_id || '|fixed|0'), 1, 16) AS c FROM documents) WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "shortcodes_rendered": """SELECT doc_id, 'A ' || source || ' and ' || lang || ' x y; ' || source || '. (feature state: beta, v1.' || doc_id || ') ' || lang || ' kept (feature gate: G)link bold' AS shown FROM documents""",
    "front_matter": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN source || ' ' || lang END AS title, md5(text) AS body_md5 FROM documents",
    "markdown_blocks": """SELECT doc_id, i::INT AS idx, p AS path, t AS text FROM documents, LATERAL (SELECT unnest(range(4)) AS i, unnest(['', 'One', 'One/Two', 'One/' || source]) AS p,
        unnest(['lead of ' || source, 'first ' || lang || chr(10) || chr(10) || 'more', '```' || chr(10) || '# no heading' || chr(10) || '```', 'tail ' || doc_id]) AS t)""",
    "common_prefixes": """SELECT page_id, array_to_string(a[1 : coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)))], '/') AS shared
        FROM (SELECT p.page_id, regexp_split_to_array(p.url, '[/.-]') AS a, regexp_split_to_array(n.url, '[/.-]') AS b FROM pages p JOIN pages n ON n.page_id = p.page_id + 1)""",
}
