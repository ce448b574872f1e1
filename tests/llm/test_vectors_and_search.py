"""Whitening, ranked lexical search and exact top-k search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.llm import lexical_search, va_search, whitening
from pitchframe.llm.oracle import op12_sql, op13_sql
from tests.llm.helpers import ODD, odd_docs

CLASHES = ("x", "v", "ids", "codes", "n", "score", "rank", "component", "deviation", "query_id", "label")


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df.repartition(5)


def clean(rows):
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in rows)
    d = max(lengths, key=lambda k: (lengths[k], k)) if lengths else 0
    return [(i, v) for i, v in rows if len(v) == d]


def some_vectors(n, d, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(2, 0.3, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(n + i, rows[1][1]) for i in range(copies)]
    return rows


BAD = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [0.5, 0.5]),
       (None, [0.25] * 6), (906, [0.25] * 6), (906, [0.25] * 6)]


# -- whitening ---------------------------------------------------------------------------------

def covariance(d, values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("d, values", [
    (1, [2.0]), (7, np.arange(1.0, 8)), (64, np.linspace(1, 1.1, 64)), (300, np.exp(-np.arange(300) / 12)),
    (300, np.r_[np.full(40, 5.0), np.linspace(2, 0.1, 260)]),  # more equal leading values than are wanted
    (200, np.r_[np.linspace(9, 1, 12), np.zeros(188)]),
])
def test_eigenpairs_equal_a_dense_solver(d, values):
    v = covariance(d, np.asarray(values, float))
    found, axes, info = whitening.eigenpairs(lambda u: v @ u, d, 32)
    k = min(32, d)
    want = np.sort(values)[::-1][:k]
    assert found.size == k and np.abs(found - want).max() < 2e-14 * want[0]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
    assert np.linalg.norm(v @ axes - axes * found, axis=0).max() < 1e-13 * want[0]
    assert info["residual"] <= whitening.ROUNDING


def test_pairs_converge_in_a_small_subspace():
    """A matrix far larger than the subspace, so that Rayleigh-Ritz alone cannot be exact."""
    v = covariance(600, np.r_[np.linspace(10, 5, 8), np.linspace(1, 0, 592)])
    found, axes, info = whitening.eigenpairs(lambda u: v @ u, 600, 8, block=4, inner=5, max_basis=40)
    assert np.abs(found - np.linspace(10, 5, 8)).max() < 1e-13 and info["passes"] < 80
    assert np.linalg.norm(v @ axes - axes * found, axis=0).max() < 1e-12


def test_minres_solves_indefinite_systems():
    v = covariance(30, np.linspace(-3, 4, 30), seed=2)
    rhs = np.random.default_rng(1).standard_normal((30, 4))
    assert np.abs(v @ whitening.minres(lambda t: v @ t, rhs, 60) - rhs).max() < 1e-9


def brute_whitening(rows, k=32):
    rows = clean(rows)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    keep = [j for j in range(e.size)[::-1] if e[j] > 1e-13 * e.sum()][:k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in x]
    return [i for i, _ in rows], deviation, (c @ u[:, keep]) / np.sqrt(e[keep]), e[keep] / e.sum()


@pytest.mark.parametrize("n, d", [(400, 6), (150, 40)])
def test_whitening_equals_a_dense_solver(spark, n, d):
    rows = some_vectors(n, d, seed=n, copies=150) + (BAD if d == 6 else [])
    random.Random(1).shuffle(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    ids, deviation, white, explained = brute_whitening(rows)
    k = white.shape[1]
    assert k == min(d, 32) and len(got) == len(ids) * k
    assert {r.n for r in got} == {len(ids)} and max(r.identity_error for r in got) < 1e-10
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == Counter(zip(ids, deviation))
    by_id = {i: w for i, w in zip(ids, white)}
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        a, b = np.array([r.whitened for r in own]), np.array([by_id[r.vec_id][c] for r in own])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert {round(r.explained / explained[c], 10) for r in own} == {1.0}


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, []).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, BAD[:5])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25])])).count() == 0  # no variance
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25])] * 9)).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [1.0, 0.25]), (2, [1.0, 0.25])])).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1)} and len(got) == 3  # one direction varies
    # x takes the values 32 and 64 over the base: (3 * 32 - 160) ** 2 and (3 * 64 - 160) ** 2
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(1, 64 ** 2), (2, 32 ** 2)}


def test_sums_beyond_one_layer(spark):
    rows = some_vectors(300, 5)
    many = vectors(spark, rows).repartition(150)
    got = whitening.prepare(many)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int) + 1_000_000
    assert got.n == 300 and got.sums == x.sum(axis=0).tolist()


# -- ranked lexical search -----------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k=10):
    def terms(text):
        return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    counts = [Counter(b) for _, b in bags]
    out = Counter()
    for item, text in items:
        scored = []
        for (i, b), tf in zip(bags, counts):
            if not b:
                continue
            m, score = 100 - 75 + (75 * len(b) * n_docs) // total, 0
            for t in terms(text):
                df = sum(t in c for c in counts)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) if tf[t] else 0
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, no, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if no else i, -s] += 1
    return out


def found_ranks(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_ranks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gam-ma", "ñandú", "日本", "a", "b", "ab", "abc", "x1", "ÉCOLE", "école", "the", "of"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(200 + i, "alpha,beta;alpha\n\tabc  ab.a") for i in range(30)]  # copies tie by id
    docs += ODD
    items = [(1, "Alpha beta ab a a"), (2, "the the of ÉCOLE"), (3, None), (4, ""), (5, "no such zzz"),
             (6, "gam ma gamma 日本"), (6, "gam ma gamma 日本"), (None, "one two nandú ñandú"), (7, "w1x1 w2x2")]
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit(2))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("r")).repartition(6)
    want = brute_ranks(docs, items)
    assert found_ranks(lexical_search.search(frame, table)) == want
    assert found_ranks(lexical_search.search(frame, table, slice_chars=30)) == want  # several automata


def test_lexical_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id int, text string")
    docs = odd_docs(spark)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items).schema.simpleString() == "struct<item_id:int,rank:int,doc_id:bigint,score:bigint>"


def test_automaton_counts_whole_terms_only():
    terms = lexical_search.Terms([b"a ab abc", b"ab cd", b""])
    got = terms.count(lexical_search.guarded(b"ab ab abcd xab,ab-A a abc"))
    assert {terms.terms[i]: n for i, n in got.items()} == {b"ab": 3, b"a": 2, b"abc": 1}
    assert lexical_search.guarded(bytes(range(128))).split() == [b"0123456789", b"abcdefghijklmnopqrstuvwxyz",
                                                                 b"abcdefghijklmnopqrstuvwxyz"]


def test_scores_beyond_exact_doubles_stay_exact(spark):
    items = [(1, "rare " * 400_000)]  # contributions near 2 ** 53
    docs = [(i, "rare " * (i + 1) + "x " * 7) for i in range(5)] + [(9 + i, "none") for i in range(3000)]
    got = found_ranks(lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"),
                                            spark.createDataFrame(items, "item_id int, text string")))
    total, n = sum(len(t.split()) for _, t in docs), len(docs)
    w = math.floor(1000 * math.log((2 * n + 2) / 11))
    want = [(400_000 * w * ((1000000000 * (i + 1)) // (1000 * (i + 1) + 8 * (25 + 75 * (i + 8) * n // total))), i) for i in range(5)]
    assert got == Counter((1, r, i, s) for r, (s, i) in enumerate(sorted(want, reverse=True), 1))


# -- exact top-k search --------------------------------------------------------------------------

def brute_search(rows, every, k=5):
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in clean(rows)]
    out = Counter()
    for at, (q, x) in enumerate(rows):
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for j, (i, y) in enumerate(rows) if j != at)
        for rank, (s, no, i) in enumerate(scored[:k], 1):
            out[q, rank, None if no else i, -s] += 1
    return out


def found_search(df):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("n, d, copies", [(400, 6, 200), (600, 24, 0), (4, 6, 0)])
def test_search_equals_brute_force(spark, n, d, copies):
    rows = some_vectors(n, d, seed=3, copies=copies) + (BAD if d == 6 else [])
    random.Random(2).shuffle(rows)
    table = vectors(spark, rows)
    want = brute_search(rows, 7)
    assert found_search(va_search.search(table, F.col("vec_id") % 7 == 0)) == want
    assert found_search(va_search.search(table, F.col("vec_id") % 7 == 0, slice_bytes=1000)) == want


def test_search_with_ties_outliers_and_coarse_cells(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(400, [1000.0, 0.0, -1000.0, 3.0]), (401, [-1e6, 1e6, 0.0, 0.0])]
    monkeypatch.setattr(va_search, "SAMPLE", 20)  # poor cells cost work, not results
    monkeypatch.setattr(va_search, "BLOCK", 64)
    assert found_search(va_search.search(vectors(spark, rows), F.col("vec_id") % 10 == 0)) == brute_search(rows, 10)


def test_search_of_odd_tables(spark):
    every = F.col("vec_id") % 2 == 0
    assert va_search.search(vectors(spark, []).limit(0), every).count() == 0
    assert va_search.search(vectors(spark, BAD[:5]), every).count() == 0
    assert va_search.search(vectors(spark, [(1, [1.0]), (3, [2.0])]), every).count() == 0
    assert va_search.search(vectors(spark, [(2, [1.0])]), every).count() == 0  # no other row
    assert found_search(va_search.search(vectors(spark, [(2, [1.0]), (2, [1.0]), (None, [1.0])]), every)) == \
        Counter({(2, 1, 2, 65536): 2, (2, 2, None, 65536): 2})
    with pytest.raises(OverflowError):
        va_search.search(vectors(spark, [(2, [1e12]), (3, [1e12])]), every)


def test_bounds_hold(spark):
    rng = np.random.default_rng(8)
    x, q = rng.integers(-200, 200, (500, 9)), rng.integers(-200, 200, (20, 9))
    cells = va_search.Cells(x[:30], x.min(axis=0), x.max(axis=0))
    mid, width = cells.bounds(cells.codes(x), q.astype(float))
    assert (np.abs(x @ q.T - mid) <= width).all()


def test_sql_of_both_searches(spark, tmp_path):
    """The SQL the checker runs, on a small fixture with ties and odd rows."""
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in some_vectors(120, 6, copies=20) + BAD if r[0] not in (905, None) and r[0] != 906]
    vectors(spark, rows).write.parquet(str(tmp_path / "e"))
    docs = [r for r in ODD if r[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "One two x"), (2, "macht den")], "item_id int, text string").write.parquet(str(tmp_path / "b"))
    con = duckdb.connect()
    for view, name in (("embeddings", "e"), ("documents", "d"), ("benchmark", "b")):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    got = con.sql(op13_sql()).df()
    assert Counter(zip(got.query_id, got["rank"], got.vec_id, got.score)) == brute_search(rows, 50)
    got = con.sql(op12_sql()).df()
    assert Counter(zip(got.item_id, got["rank"], got.doc_id, got.score)) == brute_ranks(docs, [(1, "One two x"), (2, "macht den")])
