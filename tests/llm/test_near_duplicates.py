import random

from pitchframe.llm.minhash_dedup import components, near_duplicates, shingles_of
from tests.llm.helpers import ODD, components as brute_components, odd_docs, words


def brute(rows, width, percent):
    sets = {i: shingles_of((t or "").encode(), width) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[:n]
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, brute_components(edges, list(sets))


def corpus(rng):
    rows = []
    for _ in range(12):
        base = words(rng, rng.randint(20, 200))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(words(rng, 80))
    rows += [(len(rows) + i, passage + " " + " ".join(words(rng, 40))) for i in range(90)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, percent in ((3, 85), (5, 80)):
        sets, want = brute(rows, width, percent)
        got = near_duplicates(df, width, percent).collect()
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    got = near_duplicates(odd_docs(spark), 3, 85).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[2].n_shingles == by_id[3].n_shingles == by_id[4].n_shingles == 0
    assert by_id[7].n_shingles == 1 and by_id[1].n_shingles == 4
    assert all(r.component_id == r.doc_id for r in got)
    assert near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_short_texts_and_case(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a"), (4, "a b c"), (5, "\ta  b\n"), (6, "É x"), (7, "é x")]
    got = {r.doc_id: r.component_id for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}


def test_components_of_a_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(bytes([order[i]]), bytes([order[i + 1]])) for i in range(n - 1)] + [(b"\x80", b"\x81")]
    got = {bytes(r.node): bytes(r.component) for r in components(
        spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert all(got[bytes([i])] == b"\x00" for i in range(n)) and got[b"\x81"] == b"\x80"
