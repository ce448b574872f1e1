import re
from collections import Counter

from pitchframe.llm.license_scan import BASE, WORD, license_scan
from pitchframe.llm.quality_rules import quality_rules
from tests.llm.helpers import ODD, odd_docs


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(again), failed)


def test_quality_rules_equal_brute_force(spark):
    phrase = "a b c d e f g h i j "
    more = [(20, phrase * 2 + "z"), (21, "x " + phrase + "y " * 30 + phrase), (22, "q\nq\n \nq\nr"),
            (23, "the cat and the dog of " * 3 + " ".join(f"w{i}" for i in range(60))),
            (24, "#$%& |<>* a b c\x0bd"), (25, "a " * 40)]
    df = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality_rules(df).collect()
    rows = ODD + more
    assert len(got) == len(rows)
    want = Counter((i, *brute_rules(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert next(r for r in got if r.doc_id == 23).kept


def test_quality_rules_verdict(spark):
    good = "the man and the woman went to town with a bag of bread and some milk for the long way home again"
    bad = " ".join(x + "$$$" for x in good.split())
    loud = good.upper()
    r = {x.doc_id: x.kept for x in quality_rules(
        spark.createDataFrame([(1, good), (2, bad), (3, loud)], "doc_id long, text string")).collect()}
    assert r == {1: True, 2: False, 3: False}


def test_quality_rules_of_clashing_columns_and_empty_table(spark):
    df = odd_docs(spark)
    assert quality_rules(df).count() == len(ODD)
    assert quality_rules(df.limit(0)).count() == 0


def brute_licenses(text):
    w = re.findall(WORD.replace(r"\x", r"\x"), re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, names = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        names |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)))


def test_license_scan_base_equals_brute_force(spark):
    rows = [(1, "Under the MIT License."), (2, "a under the mit license x under the mit license"),
            (3, "Apache License, Version 2.0 and CC-BY-NC"), (4, "cc by nc cc by nc"), (5, "under the under the mit license"),
            (6, "MIT license under the"), (7, "cc by"), (8, "café CC BY NC ünder the mit license")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {
        i: brute_licenses(t) for i, t in rows}
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_scan_merges_neighbouring_diagonals(spark):
    edited = ("Permission is hereby granted, free of charge, to any other person obtaining a copy of this "
              "software and associated files")
    got = license_scan(spark.createDataFrame([(1, edited), (2, "permission is hereby asked")],
                                             "doc_id long, text string")).collect()
    r = {x.doc_id: x for x in got}
    assert r[1].labels == "mit" and r[1].base_labels == "" and 0.6 <= r[1].score < 1
    assert r[2].labels == "" and r[2].score == 0


def test_license_scan_of_repeated_rows(spark):
    texts = ["here under the mit license", "Apache License, Version 2.0 and CC-BY-NC", "under the mit",
             "permission is hereby granted free of charge to any other"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts]
    once, thrice = (
        {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
         for r in license_scan(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, rows * 3))
    assert once == thrice
    assert {r[:6] for r in thrice} == {(i, *brute_licenses(t)) for i, t in rows}
    assert all(r[6] == "" for r in thrice if r[1] == 3)


def test_license_scan_odd_rows(spark):
    got = license_scan(odd_docs(spark)).collect()
    # the repeated row is one document
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in set(ODD))
    assert {r.doc_id: r.n_words for r in got}[3] == 0
    assert license_scan(odd_docs(spark).limit(0)).count() == 0
