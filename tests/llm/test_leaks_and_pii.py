import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from pitchframe.llm import decontaminate, pii
from tests.llm.helpers import ODD, odd_docs, words


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_alignment_equals_the_full_matrix():
    rng = random.Random(6)
    for _ in range(150):
        a = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 25))])
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))])
        assert decontaminate.align(a, b)[0] == smith_waterman(a, b)


def planted(rng):
    items = [(i, " ".join(words(rng, rng.randint(30, 60), 5000))) for i in range(12)]
    docs, want = [], set()
    for i in range(160):
        w = words(rng, rng.randint(20, 120), 5000)
        if i % 2:
            item = rng.randrange(12)
            copy = items[item][1].split()
            for _ in range(len(copy) * (i % 5) // 20):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = [f"edit{rng.randint(0, 99)}"]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in copy] if i % 3 == 0 else copy
            want.add((i, item))
        docs.append((i, " ".join(w)))
    # a passage that stands in very many documents keeps its seeds
    docs += [(1000 + i, " ".join(words(rng, 5)) + " " + items[3][1]) for i in range(200)]
    want |= {(1000 + i, 3) for i in range(200)}
    return items, docs, want


def test_planted_copies_are_found_and_clean_documents_left(spark):
    items, docs, want = planted(random.Random(9))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(docs)
    for r in got[:40]:
        w = decontaminate.words_of(texts[r.doc_id].encode())
        item = decontaminate.words_of(dict(items)[r.item_id].encode())
        assert abs(smith_waterman(w, item) / (2 * len(item)) - r.score) < 1e-9
        assert 0 <= r.first_word <= r.last_word < len(w)
    # slices of the benchmark give the same rows
    again = decontaminate.leaks(d, b, slice_bytes=600).collect()
    assert {(r.doc_id, r.item_id) for r in again} == want
    clean = decontaminate.clean(d, b).collect()
    assert {r.doc_id for r in clean} == {i for i, _ in docs} - {i for i, _ in want}


def test_edited_and_partial_copies_are_found_however_often_they_stand(spark):
    rng = random.Random(4)
    item = [f"item{i}" for i in range(40)]
    items = [(1, " ".join(item))]
    edited = [f"edit{i}" if i % 5 == 2 else w for i, w in enumerate(item)]
    for copy in (edited, item[11:29]):
        for n in (1, 10, 11, 1000):
            docs = [(i, " ".join(words(rng, 5) + copy + words(rng, 5))) for i in range(n)]
            docs += [(5000 + i, " ".join(words(rng, 30))) for i in range(20)]
            d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
            b = spark.createDataFrame(items, "item_id long, text string")
            assert {r.doc_id for r in decontaminate.leaks(d, b).collect()} == set(range(n))
            assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {5000 + i for i in range(20)}


def test_windows_left_out_could_not_reach_the_score():
    rng = random.Random(12)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 14))).encode() for _ in range(8)]
    bench = decontaminate.Benchmark(items)
    for _ in range(150):
        text = " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(3, 60))).encode()
        every = {m[0]: m[1:] for m in bench.matches(text, 0.0)}
        for low in (0.4, 0.7):
            assert {m[0]: m[1:] for m in bench.matches(text, low)} == {i: m for i, m in every.items() if m[0] >= low}


def test_what_many_items_share_is_no_seed():
    """10,000 items of one template: a text without a copy is answered at once, a copy is found."""
    rng = random.Random(3)
    template = words(rng, 12, 50)
    items = [" ".join(template + [f"a{i}x", f"b{i % 97}y", *words(rng, 12, 10 ** 6)]).encode() for i in range(10_000)]
    bench = decontaminate.Benchmark(items)
    text = words(rng, 2700, 5000)
    for at in range(0, 2600, 60):
        text[at:at] = template
    clean = " ".join(text).encode()
    began = time.process_time()
    assert bench.matches(clean, decontaminate.MIN_SCORE) == []
    assert time.process_time() - began < 0.5
    copy = " ".join(text[:500] + items[77].decode().split() + text[500:]).encode()
    assert [(m[0], m[1]) for m in bench.matches(copy, decontaminate.MIN_SCORE)] == [(77, 1.0)]


def test_recall_on_edited_copies():
    """Planted edits of a growing share of the words, against a full alignment of every pair."""
    rng = random.Random(8)
    items = [words(rng, rng.randint(25, 50), 3000) for _ in range(60)]
    bench = decontaminate.Benchmark([" ".join(i).encode() for i in items])
    found = asked = 0
    for i in range(300):
        copy = [w if rng.random() > (i % 4) / 12 else f"edit{rng.randint(0, 99)}" for w in items[i % 60]]
        text = words(rng, 40, 3000) + copy + words(rng, 40, 3000)
        ids = np.array([bench.word.get(w.encode(), -1) for w in text])
        if decontaminate.align(ids, bench.items[i % 60])[0] / (2 * len(copy)) >= decontaminate.MIN_SCORE:
            asked += 1
            found += i % 60 in [m[0] for m in bench.matches(" ".join(text).encode(), decontaminate.MIN_SCORE)]
    assert asked > 250 and found >= 0.97 * asked


def test_items_with_the_same_words_are_all_named(spark):
    rows = [(i, "Some words, that many items share word by word here") for i in range(30)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y some words that many items share word by word here z"), (2, "some words")],
                                 "doc_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(1, i, 1.0) for i in range(30)} and len(got) == 30


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "one two")],
                                  "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = decontaminate.leaks(odd_docs(spark), items).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(1, 1, 1.0)] * 2
    assert decontaminate.leaks(odd_docs(spark), items.limit(0)).count() == 0
    assert decontaminate.leaks(odd_docs(spark).limit(0), items).count() == 0
    kept = decontaminate.clean(odd_docs(spark), items)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(ODD) - 2


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    out = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in p.finditer(text) if good(k, m.group())]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for alphabet in ("ab.@-_ 1é", "0123.+ -()", "12. +-@a", "4111 -", "1.2"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert brute_spans(t) == pii.base_spans(t), t
    assert [s[2] for s in pii.base_spans("call +1 (555) 010-9999 or 4111 1111 1111 1111, 10.0.0.1, é@x.y, a@b.co")] == [
        "phone", "card", "ip", "email"]


def test_long_runs_take_linear_time():
    for t in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(t)


def disclosing_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 12)) + f" signed Quuxley {''.join(rng.choices('abcdef', k=6))} write jq@example.com now "
             + " ".join(words(rng, 10))) for i in range(8)]
    rows += [(100 + i, " ".join(words(rng, 30)) + " signed and write now") for i in range(150)]
    # copies of one text are one context, no evidence
    rows += [(500 + i, "Copied words around me@copy.example here again") for i in range(9)]
    return rows


def test_terms_that_reveal_an_entity(spark):
    rows = disclosing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    texts = dict(rows)
    for i, r in got.items():
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = [s for s in spans if s[2] != "term"]
        assert base == brute_spans(texts[i])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        terms = [texts[i][a:b] for a, b, k in spans if k == "term"]
        assert terms == (["Quuxley"] if i < 100 else [])
    clean = {r.doc_id: r.text for r in pii.sanitise(df.withColumn("spans", F.lit(1))).collect()}
    assert "Quuxley" not in clean[0] and "[email]" in clean[0] and clean[100] == texts[100]
    assert clean[500] == "Copied words around [email] here again"


def test_a_shared_signature_in_different_texts_is_evidence(spark):
    rng = random.Random(8)
    around = "with kind regards from all of us here Quuxley jq@example.com please do write to us soon again"
    far = "reach Zorbley " + "." * 400 + " zz@example.org"
    rows = [(i, " ".join(words(rng, 20)) + f" {around} " + " ".join(words(rng, 20))) for i in range(12)]
    rows += [(50 + i, " ".join(words(rng, 20)) + f" {far} " + " ".join(words(rng, 20))) for i in range(6)]
    rows += [(100 + i, " ".join(words(rng, 30)) + " with kind regards from all of us here please do write to us soon "
              "again reach") for i in range(250)]
    rows += [(500 + i, "copied Names around me@copy.example") for i in range(9)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in got:
        assert "Quuxley" not in r.text and "Zorbley" not in r.text
        if 100 <= r.doc_id < 500:
            assert r.text == texts[r.doc_id]
        elif r.doc_id >= 500:
            assert r.text == "copied Names around [email]"


def test_pii_odd_rows(spark):
    got = pii.find(odd_docs(spark)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got)
    same = pii.sanitise(odd_docs(spark))
    assert same.columns == odd_docs(spark).columns
    assert sorted(map(str, same.select("doc_id", "text").collect())) == sorted(
        map(str, odd_docs(spark).select("doc_id", "text").collect()))
    assert pii.find(odd_docs(spark).limit(0)).count() == 0
