"""Similarity operators against brute force on small fixtures with awkward rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from quillon.llm import decontaminate, embedding_dedup, ngram_join
from quillon.llm.common import Scratch, components
from quillon.llm.textkit import Words

DOCS = "doc_id long, text string, id string, cls long, key int, n string"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    comp = list(range(len(sets)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and den * len(x & y) >= num * len(x | y):
            comp[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)), key=str)


def near_texts(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 12])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.2:
                t = t[rng.randint(0, 3) :]
            rows.append((n, " ".join(t)))
            n += 1
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(n + i, passage + " " + " ".join(rng.choice(vocab) for _ in range(40 + i))) for i in range(12)]
    n += 12
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one\ttwo"), (n + 5, "x"), (n + 6, "the " * 3000), (n + 7, "the " * 2990), (0, rows[0][1]), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(spark, k, num, den):
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS)
    got = ngram_join.jaccard_components(df, k=k, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, k, num, den)


def test_cells_split_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 5)
    monkeypatch.setattr(ngram_join, "NODE", 2)
    rows = near_texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, k=3, num=80, den=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 3, 80, 100)


def test_jaccard_empty_and_bad(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(spark.createDataFrame([], DOCS), num=101)


def test_linked_sets_share_cells():
    """The guarantee: any two sets within the similarity share at least ``least`` cells of either."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        table = ngram_join.bands(5000, num, den)
        starts = np.array([x[0] for x in table])
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, max(1, n // 8) + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, n // 10) + 1)).astype(np.uint64))))
            if not len(b):
                continue
            inter = len(np.intersect1d(a, b))
            (x, lx), (y, ly) = (ngram_join.cell_keys(s, table, starts, num, den) for s in (a, b))
            if den * inter >= num * (len(a) + len(b) - inter):
                assert len(np.intersect1d(x, y)) >= max(lx, ly) >= 1


def test_one_of_each_group(spark):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(1, long, "k1"), (2, long + " end", "k2"), (3, "other text of five words", "k3"), (3, "other text of five words", "k3"), (None, long, "k4"), (4, None, "k5"), (5, "", None)]
    got = ngram_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, id string"))
    assert sorted(((r.doc_id, r.id) for r in got.collect()), key=str) == sorted([(1, "k1"), (3, "k3"), (None, "k4"), (4, "k5"), (5, None)], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    comp = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == comp and got.count() == len(comp)
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, least=0.95):
    good = [(i, np.array(v, float) / np.linalg.norm(v)) if v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v) else (i, None) for i, v in rows]
    n, comp = [0] * len(good), list(range(len(good)))
    for a, b in combinations(range(len(good)), 2):
        if good[a][1] is not None and good[b][1] is not None and good[a][1] @ good[b][1] >= least:
            n[a] += 1
            n[b] += 1
            comp = [comp[a] if c == comp[b] else c for c in comp]
    low = {}
    for i, (d, _) in enumerate(good):
        low[comp[i]] = min(d, low.get(comp[i], d))
    return sorted((d, n[i], low[comp[i]], d == low[comp[i]]) for i, (d, _) in enumerate(good))


@pytest.mark.parametrize("chunk", [1024, 7])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(25):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 8)):
            rows.append((n, (base + rng.normal(size=8) * 0.02).tolist()))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 8), (n + 5, [1.0] * 7 + [None]), (n + 6, [1.0] * 7 + [float("nan")]), (n + 7, [float("inf")] * 8), (n + 8, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id string, cls int")
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(df).collect())
    want = brute_vectors(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.9 * all_links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found < all_links or got == want
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_vectors_of_every_size_are_compared(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim, groups in ((8, 12), (5, 4), (3, 1)):
        for _ in range(groups):
            base = rng.normal(size=dim)
            rows += [(len(rows) + k, (base + rng.normal(size=dim) * 1e-4).tolist()) for k in range(3)]
    rows += [(len(rows), rows[36][1]), (len(rows) + 1, [1.0] * 4)]
    got = {r.id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, v in rows:
        near = [j for j, w in rows if len(w) == len(v) and np.dot(v, w) >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i].n_links == len(near) - 1 and got[i].component_id <= min(near)


@pytest.mark.parametrize("pivots, few", [(256, 4), (512, 64)])
def test_partners_near_the_threshold_in_64_dimensions(spark, monkeypatch, pivots, few):
    monkeypatch.setattr(embedding_dedup, "pivot_number", lambda n: pivots)
    monkeypatch.setattr(embedding_dedup, "FEW", few)
    rng = np.random.default_rng(3)
    x = embedding_dedup.normalised(rng.normal(size=(3000, 64)))
    z = rng.normal(size=(600, 64))
    z = embedding_dedup.normalised(z - (z * x[:600]).sum(1, keepdims=True) * x[:600])
    cos = np.repeat([0.951, 0.949], 300)[:, None]
    rows = np.concatenate((x, cos * x[:600] + np.sqrt(1 - cos**2) * z)) * rng.uniform(0.1, 9, size=(3600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.id: r for r in embedding_dedup.near_vectors(df).collect()}
    found = sum(got[3000 + i].n_links == 1 and got[3000 + i].component_id == i and not got[3000 + i].kept for i in range(300))
    assert found >= 0.95 * 300
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in [*range(300, 3000), *range(3300, 3600)])


def test_a_large_group_of_near_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    base, other = rng.normal(size=16), rng.normal(size=16)
    rows = [(i + 5, (base + rng.normal(size=16) * 0.02).tolist()) for i in range(2500)] + [(7, other.tolist()), (7, other.tolist()), (9, None), (9, [0.0] * 16)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    near = [r for r in got if r.n_links > 1]
    assert len(near) == 2500 and {r.component_id for r in near} == {5} and sum(r.n_links for r in near) >= 0.9 * 2500 * 2499
    assert sorted((r.id, r.n_links, r.component_id) for r in got if r.n_links <= 1) == [(7, 1, 7), (7, 1, 7), (9, 0, 9), (9, 0, 9)]


def test_pivots_grow_with_the_root_of_the_vectors():
    assert [embedding_dedup.pivot_number(n) for n in (0, 1, 2000, 51282, 10**6, 10**12)] == [256, 256, 256, 512, 2048, embedding_dedup.MOST_PIVOTS]


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(6)
    x = embedding_dedup.normalised(rng.normal(size=(200, 24)) * rng.uniform(0, 3, size=24) ** 3)
    q, scale, rest = embedding_dedup._sketch(x)
    y = q * scale[:, None].astype(np.float32)
    upper = embedding_dedup._upper(y @ y.T, 24, rest[:, None], rest[None, :])
    assert (upper >= x @ x.T).all() and (upper - x @ x.T).max() < 0.1


def passages():
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "only three words"), (93, items_text := "a b c d e")]
    docs = []
    for n in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([5, 40, 200]))]
        kind = n % 4
        if kind:
            p = items[rng.randrange(40)][1].split()
            if kind == 2:
                p[rng.choice([0, -1])] = "changed"
            if kind == 3:
                p = p[rng.randint(0, 4) : len(p) - rng.randint(0, 3)]
            at = rng.randrange(len(w))
            w[at:at] = p
        docs.append((n, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "Only THREE words"), (203, "x " * 5000 + items_text), (204, items[0][1]), (205, items[1][1].rsplit(" ", 1)[0]), (204, items[0][1])]
    return items, docs


def test_contamination(spark):
    items, docs = passages()
    d, b = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.WindowIndex([(i, t) for i, t in items if t is not None])
    want = []
    for i, t in docs:
        h, _ = decontaminate._shingles(Words([(t or "").encode()]))
        for j, s in enumerate(index.sets):
            best = max((index.similarity(h[a : a + len(s)], j) for a in range(max(1, len(h) - len(s) + 1))), default=0) if len(s) and len(h) else 0
            if best >= 0.8:
                want += [(i, k) for k in index.ids[j]]
    got = [(r.id, r.item_id) for r in decontaminate.contamination(d, b).collect()]
    assert sorted(got) == sorted(want) and len(want) > 60
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {x for x, _ in want})
    assert decontaminate.contamination(d.where("false"), b).count() == 0 and decontaminate.contamination(d, b.where("false")).count() == 0


def test_passes_over_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 7)
    items, docs = passages()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    some = {(r.id, r.item_id) for r in decontaminate.contamination(d, b).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2000)
    assert some == {(r.id, r.item_id) for r in decontaminate.contamination(d, b).collect()}


def test_weights_are_counted_over_the_whole_benchmark(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"u{rng.randrange(5000)}"
    common = [word() for _ in range(22)]
    # items that share a passage, and windows with some of it changed
    items = [(i, " ".join(common + [word() for _ in range(22)])) for i in range(9)]
    rows = []
    for i, t in items:
        for cut in range(12):
            w = t.split()
            w[:cut] = [word() for _ in range(cut)]
            rows.append((len(rows), " ".join(w)))
            w = t.split()
            w[len(w) - cut :] = [word() for _ in range(cut)]
            rows.append((len(rows), " ".join(w)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    find = lambda: sorted((r.id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contamination(d, b).collect())
    whole = find()
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    assert find() == whole and 20 < len(whole) < len(rows)


def test_equal_items_count_once(spark):
    words_ = [f"z{i}" for i in range(44)]
    items = [(i, " ".join(words_) if i % 2 else "  ".join(words_).upper()) for i in range(5)]
    d = spark.createDataFrame([(1, " ".join(["before"] * 9 + words_[:42] + ["other", "end"] + ["after"] * 9))], "doc_id long, text string")
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.item_id for r in got) == [0, 1, 2, 3, 4] and all(abs(r.similarity - 38 / 42) < 1e-9 for r in got)


@pytest.mark.parametrize(("n", "listed"), [(20, 3), (10_000, 2), (40_000, 1)])
def test_multi_index_finds_the_whole_radius(n, listed):
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**64, n, dtype=np.uint64)
    lists = decontaminate.BlockLists(prints, np.arange(n) + 7)
    assert len(lists.probes) == len(decontaminate._masks(decontaminate.BLOCK_RADIUS - listed))
    some = rng.integers(0, n, 60)
    off = [sum(1 << int(b) for b in rng.permutation(64)[: decontaminate.RADIUS + k % 2]) for k in range(60)]
    windows = prints[some] ^ np.array(off, np.uint64)
    at, item = lists.retrieve(windows)
    want = np.nonzero(np.bitwise_count(windows[:, None] ^ prints) <= decontaminate.RADIUS)
    assert sorted(zip(at.tolist(), (item - 7).tolist(), strict=True)) == sorted(zip(want[0].tolist(), want[1].tolist(), strict=True)) and len(at) >= 30


def test_ten_thousand_items(spark):
    rng = random.Random(10)
    items = [(i, " ".join(f"v{rng.randrange(20000)}" for _ in range(rng.randint(20, 50)))) for i in range(10_000)]
    rows, want = [], set()
    for n in range(200):
        w = items[n * 50][1].split()
        if n % 3 == 0:
            w[-1] = "changed"
        elif n % 3 == 1:
            w = [x for x in w[:3]] * 4
        rows.append((n, " ".join([f"v{rng.randrange(20000)}" for _ in range(30)] + w + ["after"] * 20)))
        if n % 3 != 1:
            want.add((n, n * 50))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item_id) for r in decontaminate.contamination(d, b).collect()} == want


def test_count_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    base = rng.poisson(3, (40, 64))
    v = np.concatenate([np.maximum(0, b + rng.integers(-1, 2, (60, 64)) * (rng.random((60, 64)) < 0.05)) for b in base])
    n = v.sum(1)
    order = np.argsort(n, kind="stable")
    v, n = v[order], n[order]
    tree = ngram_join.CountTree(v, n, 90, 100)
    assert [len(x[0]) for x in tree.levels] == [75, 3]
    for i in range(0, len(n), 37):
        over = np.minimum(v[i + 1 :], v[i]).sum(1)
        want = np.flatnonzero(over * 190 >= 90 * (n[i + 1 :] + n[i])) + i + 1
        assert set(want) <= set(tree.probe(i).tolist()) and len(tree.probe(i)) == len(want)


def test_groups_with_maps_and_hot_copies(spark):
    """One row of each group stays, where rows have maps and a third of all rows are one text."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text, {"a": i % 2}) for i in range(100)] + [(i, text + f" x{i}", {"a": 1}) for i in range(100, 140)] + [(500, "other words here", None)] * 3 + [(501, None, {})]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    got = ngram_join.one_of_each_group(d).collect()
    assert sorted(r.doc_id for r in got) == [0, 500, 501] and all(r.extra == {"a": 0} for r in got if r.doc_id == 0)
