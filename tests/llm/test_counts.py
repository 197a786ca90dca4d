"""Token counts, periodic runs and the filter audit against brute force and the library itself."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import filter_audit, periodic_runs, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " \n\t", "x", "...", "word " * 3000, "É à" * 3, "Ａ b\x1c c\x85d", "a" * 5000]


def clashing(spark, rows):
    """(doc_id, text, lang) with further columns whose names clash with those of results."""
    return spark.createDataFrame(
        [(i, t, la, "s", 1, 2, 0.5) for i, t, la in rows], "doc_id long, text string, lang string, id string, n_tokens int, mask int, words double"
    )


# token counts


def texts_of_tokens():
    rng = random.Random(5)
    letters = "abcdefghij'"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(300)]
    out = [rng.choice(["", " ", "\n\n"]) + rng.choice([" ", "  ", "\t "]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)]
    odd = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "don't 've ''s 12ab34 !?  x", "日本語 テスト 한국어 ١٢٣ ½ 𝟘", "՘x₏ y", "🙂🙂 \U0001fac8"]
    return out + odd + ODD


@pytest.mark.parametrize("sample", [0, 50])
def test_token_counts_are_the_librarys(spark, sample):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = texts_of_tokens()
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id", None), (3, texts[3], "en")]
    got = token_counts.count_tokens(clashing(spark, rows), path, sample_texts=sample).collect()

    def want(i, t):
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        return i, len((t or "").encode()), n, n > 512

    assert Counter(map(tuple, got)) == Counter(want(i, t) for i, t, _ in rows)


def test_token_counts_of_no_rows_and_of_cut_texts(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(clashing(spark, [(1, "x", "en")]).where("false"), path).collect() == []
    raw = token_counts.read_tokenizer(path)
    whole = token_counts.PieceCounter(raw)
    texts = [t or "" for t in texts_of_tokens()]
    want = [len(whole.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [whole.count(t) for t in texts] == want
    encoded = whole.misses
    assert [whole.count(t) for t in texts] == want
    assert whole.misses - encoded == sum(len(t) > token_counts.LONGEST_KEPT and t.isalpha() for t in texts)
    monkeypatch.setattr(token_counts, "PIECES_AT_ONCE", 7)
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 20)
    small = token_counts.PieceCounter(raw, {" b": 1})
    assert [small.count(t) for t in texts] == want and len(small.cache) <= max(20, max(map(len, texts)))


def test_every_character_is_cut_as_the_library_cuts_it():
    raw = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    counter = token_counts.PieceCounter(raw)
    for c in map(chr, [*range(0x20, 0x3000, 7), 0x558, 0x88F, 0xA7CE, 0x10940, 0x1FAC8, 0xE000, 0x10FFFF]):
        text = f"a{c}{c}b 1{c} {c}  {c}\n{c}x"
        assert [p for part in counter.cut(text) for p in part] == [text[a:b] for _, (a, b) in counter.tok.pre_tokenizer.pre_tokenize_str(text)]


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


# periodic runs


def brute_runs(w):
    """Every maximal interval of each period, with its smallest period."""
    best, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                best.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def repetitive(rng, n):
    out, vocab = [], rng.choice([1, 2, 3, 40])
    while len(out) < n:
        block = [rng.randrange(vocab) for _ in range(rng.randint(1, 15))]
        out += block * rng.choice([1, 1, 3, 8, 30])
        out += block[: rng.randint(0, len(block))]
    return out[:n]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    cases = [repetitive(rng, rng.randint(1, 400)) for _ in range(400)] + [[0] * 200, list(range(100)), [0, 1] * 60, ([0] * 30 + [1]) * 4, []]
    assert sum(len(brute_runs(w)) for w in cases) > 500
    for w in cases:
        assert periodic_runs.find_runs(np.array(w, np.int64)) == brute_runs(w), w
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(3, np.int64), min_power=2)


def test_very_repetitive_texts_take_no_longer():
    n = 60_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic_runs.find_runs(np.arange(n) % 700) == [(0, n, 700)]


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng, rng.randint(0, 150))), "en") for i in range(150)]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "no id " * 20, "en"), (3, rows[3][1], "en")]
    docs = clashing(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in rows:
        w = planted(i, (t or "").encode().split()) if i is not None else (t or "").encode().split()
        runs = brute_runs(w)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        milli = 1000 * top[1] // top[2] if runs else None
        said, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), b" ".join(x for k, x in enumerate(w) if k not in drop)
        want.append((i, len(runs), *top, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want) and sum(r[1] for r in want) > 100
    assert periodic_runs.periodic_runs(docs.where("false")).collect() == []


# filter audit


def audit_of(rows, labels):
    """The audit by plain Python."""
    lab = {}
    for i, q, x in ((i, q, x) for i, q, x in labels if i is not None):
        good, toxic = lab.get(i, (False, False))
        lab[i] = good or q == 1, toxic or x == 1
    seen, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = t.encode().split()
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > seen[t]]
        docs.append((part or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, *lab.get(i, (False, False))))
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in orders:
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in mine if f in d[1] and not d[1] & before]
                out[part, order, k + 1] = [
                    sum(not d[1] & (before | {f}) for d in mine), len(here), sum(f in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in here), sum(d[3] for d in here),
                ]
        for f in "ABCDE":
            total = sum(out[part, o, o.index(f) + 1][1] for o in orders)
            for o in orders:
                out[part, o, o.index(f) + 1].append(total)
    return {(*k, *v) for k, v in out.items()}


def audited_rows():
    rng = random.Random(2)
    vocab = [f"wörd{i}" for i in range(300)] + ["CAPS", "A#b", "$5", "x|y"]
    rows = []
    for i in range(120):
        words = rng.choices(vocab[: rng.choice([60, 304])], k=rng.choice([20, 99, 100, 101, 180]))
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words), rng.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[i % 7][1], rng.choice(["en", "fr"])) for i in range(40)]
    return rows + [(300 + i, t, "en") for i, t in enumerate(ODD)] + [(None, rows[0][1], "en"), (None, None, None), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]


def test_audit_equals_brute_force(spark):
    rows = audited_rows()
    labels = [(i, i % 4 // 2, i % 3 == 0) for i in range(0, 300, 2)] + [(4, 0, 1), (4, None, None), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(i, q, int(x) if x is not None else None) for i, q, x in labels], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(clashing(spark, rows), frame)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert {tuple(r) for r in got.collect()} == audit_of(rows, labels)
    assert filter_audit.filter_audit(clashing(spark, rows).where("false"), frame).collect() == []


def test_audit_equals_its_sql(spark, tmp_path):
    rows = [r for i, r in enumerate(audited_rows()) if r[0] is not None and i < 160]
    clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 4 // 2, i % 3 % 2) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.op13_filter_audit(spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = db.execute(filter_audit.OP13_SQL).fetchall()
    assert {tuple(r) for r in got.collect()} == set(want) and len(want) == 600 * len({r[2] or "" for r in rows})


@pytest.mark.parametrize("window", [16, 64, 1 << 18])
def test_scan_counts_by_any_window(monkeypatch, window):
    monkeypatch.setattr(filter_audit, "WINDOW", window)
    texts = [t for _, t, _ in audited_rows()] + ["x" * 40, "y " + "x" * 40 + " " + "x" * 40, " " * 70, "a b " * 20 + "z" * 16 + " " + "z" * 16, None]
    for array in (pa.array(texts, pa.string()), pa.array(["skip", *texts], pa.large_string())[1:]):
        counts, digests = filter_audit.scan(array)
        for t, c, d in zip(texts, counts.tolist(), digests, strict=True):
            t = t or ""
            w = t.encode().split()
            assert c == [len(w), len(set(w)), sum("A" <= x <= "Z" for x in t), sum(x in "#$%&*|" for x in t), len(t)], t
            assert d == hashlib.sha256(t.encode()).digest()


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "mix", lambda h: h & np.uint64(3))
    texts = ["a b c d e f g a", "long longer long longest", "", "same same"]
    assert filter_audit.scan(pa.array(texts))[0][:, 1].tolist() == [7, 3, 0, 1]
