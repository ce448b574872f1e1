import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pitchframe.llm import language_id, quality_classifier, toxicity
from pitchframe.llm.common import documents, held_out, labels
from tests.llm.helpers import ODD, odd_docs, words

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["stupid", "idiot", "pathetic", "worthless", "scum"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {}, set(terms))
    rng = random.Random(3)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = [rng.choice("abdeiostu")] * rng.randint(0, 1)
        w = "".join(w)
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(len(t))]
        assert lexicon.nearest(w) == ((min(near)[1], min(near)[0]) if [x for x in near if toxicity.edits(len(x[1]))] else None) \
            or min(near)[1] == "scum"
        if near and toxicity.edits(len(min(near)[1])) < 2 and min(near)[1] != "scum":
            assert lexicon.match(w) is not None, w


def test_match_equals_edit_distance_for_every_limit():
    terms = ["stupid", "idiot", "pathetic", "worthless", "degenerates", "nincompoops"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {}, set(terms))
    assert lexicon.match("wprthlesz") == ("worthless", 2)
    rng = random.Random(13)
    for _ in range(6000):
        term = rng.choice(terms)
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = [rng.choice("abdeiostu")] * rng.randint(0, 1)
        w = "".join(w)
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(len(t))]
        assert lexicon.match(w) == ((min(near)[1], min(near)[0]) if near else None), w


def lexicon_of(spark, toxic):
    rng = random.Random(21)
    rows = [(" ".join(words(rng, 30)), 0) for _ in range(300)]
    rows += [(" ".join(words(rng, 10) + list(own)), 1) for own in toxic]
    return toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))


def test_misspellings_of_words_a_stem_covers(spark):
    lexicon = lexicon_of(spark, [[w] for w in ("soddenness", "soddenling") for _ in range(12)])
    assert any("soddenness".startswith(x) for x in lexicon.stems) and lexicon.match("soddenish")[1] == 0
    assert lexicon.match("xoddenness") == ("soddenness", 1)


def test_every_term_that_passes_the_tests_is_admitted(spark):
    many = [f"{a}{b}{c}q{a}" for a in "bcdfghklm" for b in "aeiou" for c in "npqrstvwxz"] + ["zzz", "xq", "y" * 60]
    lexicon = lexicon_of(spark, [many] * 12)
    assert set(many) <= set(lexicon.words)
    more = [f"{a}{b}{c}w{a}u" for a in "bcdfghklm" for b in "aeiou" for c in "npqrstvwxz"]
    assert set(many + more) <= set(lexicon_of(spark, [many + more] * 12).words)
    assert lexicon.match("zzz") == ("zzz", 0) and lexicon.match("zzy") is None


def test_context_tells_quotation_from_abuse():
    quoted = "he said the word \"idiot\" was used".split()
    plain = "look at this big idiot over there".split()
    aimed = "you are such a big idiot".split()
    at = [t.index(next(x for x in t if "idiot" in x)) for t in (quoted, plain, aimed)]
    q, p, a = [toxicity.context(t, i, [i]) for t, i in zip((quoted, plain, aimed), at)]
    assert q < p < a


def test_quotation_marks_are_paired():
    def weight(text):
        tokens = text.split()
        i = next(i for i, t in enumerate(tokens) if "idiot" in t)
        return toxicity.context(tokens, i, [i])

    assert weight('"hello" you idiot "bye" now') == weight("you idiot now") == 1.25
    for text in ('a "big idiot" here', 'a "idiot" here', 'a “very big idiot indeed”. so', "x 'idiot' y", 'a " big idiot " b',
                 '"one" and "idiot two" three'):
        assert weight(text) == 0.4, text
    for text in ('"one two" idiot three', 'one idiot "two three"', '"one" idiot "two"', '" one " idiot " two "', 'an idiot"',
                 '"an open idiot and nothing more'):
        assert weight(text) == 1.0, text


def test_long_terms_take_a_band(spark):
    import time

    term = "".join(random.Random(1).choices("abcdefgh", k=2000))
    lexicon = toxicity.Lexicon({term: 1.0, term[:1999] + "x": 1.0}, {}, {term, term[:1999] + "x"})
    near = term[:900] + "z" + term[901:1500] + term[1501:]
    began = time.process_time()
    assert lexicon.match(near) == (term, 2) and lexicon.match("q" + near) is None
    assert time.process_time() - began < 0.5


def toxic_corpus(spark, n=900):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        w = words(rng, rng.randint(10, 80))
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["dreadful", "nincompoop", "sodden" + rng.choice("aeiou") * 2]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_toxicity_finds_held_out_and_misspelled(spark):
    docs, marks = toxic_corpus(spark)
    model = toxicity.fit(docs, marks, ~held_out("doc_id", 3, 1))
    got = toxicity.score(docs, model).join(marks, "doc_id").filter(held_out("doc_id", 3, 1)).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    new = spark.createDataFrame([(1, "b1 nincompop c2 dreadfull d4 nincompoop e5"), (2, "b1 c2 d3 e4")], "doc_id long, text string")
    r = {x.doc_id: x for x in toxicity.score(new, model).collect()}
    assert r[1].predicted == 1 and r[1].n_hits == 3 and r[2].predicted == 0


def test_toxicity_odd_rows(spark):
    docs, marks = toxic_corpus(spark, 300)
    model = toxicity.fit(docs, marks, F.lit(True))
    got = toxicity.score(odd_docs(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(odd_docs(spark).limit(0), model).count() == 0
    none = toxicity.fit(docs, marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs.limit(5), none).collect()} == {0.0}


def test_language_held_out_accuracy(spark):
    docs = documents(spark, SF)
    langs, matrix = language_id.fit(docs.filter(~held_out("doc_id", 4, 2)))
    assert np.allclose(np.exp(matrix.astype(float)).sum(axis=0), 1, atol=1e-3)
    got = language_id.score(docs, langs, matrix).join(docs.select("doc_id", "lang"), "doc_id").filter(
        held_out("doc_id", 4, 2)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def plain_grams(text):
    """Buckets of the n-grams of one text, by plain Python."""
    codes, last = [], False
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif last:
            codes.append(32)
        last = c.isalpha()
    out, mask = [], (1 << 64) - 1
    for size in language_id.SIZES:
        for at in range(len(codes) - size + 1):
            h = 0
            for n, c in enumerate(codes[at:at + size], 1):
                h = (h * 0x9E3779B97F4A7C15 + c + n) & mask
            out.append((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> (64 - language_id.BITS))
    return out


def test_language_features_equal_plain_python_at_any_chunk():
    rng = random.Random(4)
    texts = ["Ab, c!  Éa", "", "!!!", "a", " a", "日本語 and ñandú", "x" * 40]
    texts += ["".join(rng.choices("abcÉñ .,1日", k=rng.randint(1, 80))) for _ in range(60)]
    for text in texts:
        want = sorted(plain_grams(text))
        for chunk in (1, 2, 3, 4, 5, 7, 50, language_id.CHUNK):
            assert sorted(f for x in language_id.features(text, chunk) for f in x.tolist()) == want, (text, chunk)


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices(a, k=4)) for _ in range(rng.randint(1, 8))), lang)
            for i, (lang, a) in enumerate([("xx", "abcd"), ("yy", "cdef"), ("zz", "éñab")] * 15)]
    langs, matrix = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: Counter() for lang in ("xx", "yy", "zz")}
    for _, text, lang in rows:
        counts[lang].update(plain_grams(text))
    buckets = 1 << language_id.BITS

    def log_p(lang, bucket):
        return math.log((counts[lang][bucket] + 0.5) / (sum(counts[lang].values()) + 0.5 * buckets))

    assert langs == sorted(counts)
    seen = sorted(set().union(*counts.values()))
    for j, lang in enumerate(langs):
        assert np.allclose(matrix[seen, j], [log_p(lang, b) for b in seen], atol=1e-4)
    new = [(i, " ".join("".join(rng.choices("abcdeféñ", k=3)) for _ in range(5))) for i in range(30)]
    got = language_id.score(spark.createDataFrame(new, "doc_id long, text string"), langs, matrix).collect()
    for (_, text), r in zip(new, sorted(got, key=lambda r: r.doc_id)):
        grams = plain_grams(text)
        sums = [sum(log_p(lang, g) for g in grams) for lang in langs]
        odds = [math.exp((x - max(sums)) / len(grams) * 20) for x in sums]
        assert r.lang_pred == langs[sums.index(max(sums))] and abs(r.score - 1 / sum(odds)) < 1e-3


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(1, "aaa bbb", "xx"), (2, "ccc ddd", "yy"), (3, "zzz", None), (4, None, "yy")],
                                  "doc_id long, text string, lang string")
    langs, matrix = language_id.fit(train)
    assert langs == ["xx", "yy"]
    got = language_id.score(odd_docs(spark), langs, matrix).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    new = spark.createDataFrame([(1, "bbb aaa!"), (2, "CCC"), (3, "123 ...")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.score(new, langs, matrix).orderBy("doc_id").collect()] == ["xx", "yy", "und"]
    nothing = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.score(new, *nothing).collect()} == {"und"}
    assert language_id.score(odd_docs(spark).limit(0), langs, matrix).count() == 0


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 5000):
        text = bytes(i % 251 for i in range(n))
        x = quality_classifier.chunks(text)
        back = {}
        for c, row in enumerate(x):
            for j, v in enumerate(row):
                if v:
                    back[c * quality_classifier.HOP + j] = v - 1
        assert bytes(back[i] for i in sorted(back)) == text and len(back) == n


def test_batch_scores_equal_single_scores():
    rng = np.random.default_rng(1)
    net = quality_classifier.Network()
    net.p["w"][:] = rng.normal(0, 1, net.p["w"].size)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 300, 5000, 150_000, 40)]
    assert np.allclose(net.score_batch(texts), [net.score(t) for t in texts], atol=1e-5)


def test_filters_meet_patterns_at_other_offsets():
    text = bytes(np.random.default_rng(3).integers(32, 127, 200).astype(np.uint8))

    def seen(t):
        return {tuple(w) for w in quality_classifier.channels(quality_classifier.chunks(t))[0][0].tolist() if min(w)}

    assert len(seen(text)) >= 96 and seen(text) <= seen(b"ab" + text)


def test_training_reads_whole_texts(spark):
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 117, 3000).astype(np.uint8)) for _ in range(320)]
    # what tells the labels apart begins only after 3,000 bytes, in one text after 150,000
    texts = [t + (b"#$%&" if i % 2 else b"WXYZ") * 150 for i, t in enumerate(texts)]
    texts[0] = texts[0][:3000] * 50 + texts[0][3000:]
    rows = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(320)], "doc_id long, quality int")
    net = quality_classifier.fit(rows, marks, F.lit(True))
    got = quality_classifier.score(rows, net, threshold=0.5).collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in got) >= 0.98 * len(got)


def test_training_in_blocks_equals_one_block(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 117, n).astype(np.uint8)) for n in rng.integers(0, 9000, 40)]
    marks = [i % 2 for i in range(40)]
    nets = []
    for block in (100_000, 7):
        monkeypatch.setattr(quality_classifier, "BLOCK", block)
        nets.append(quality_classifier.Network())
        nets[-1].fit(texts, marks, epochs=1)
    for k, v in nets[0].p.items():
        assert np.allclose(v, nets[1].p[k], atol=1e-3), k


def test_quality_held_out_accuracy(spark):
    docs, marks = documents(spark, SF), labels(spark, SF)
    net = quality_classifier.fit(docs, marks, ~held_out("doc_id", 5, 0))
    got = quality_classifier.score(docs, net).join(marks, "doc_id").filter(held_out("doc_id", 5, 0)).collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)
    good = {r.doc_id for r in got if r.predicted == 1}
    kept = {r.doc_id for r in quality_classifier.keep(docs, net).filter(held_out("doc_id", 5, 0)).collect()}
    assert good <= kept


def test_quality_odd_rows(spark):
    net = quality_classifier.fit(odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    got = quality_classifier.score(odd_docs(spark), net).collect()
    assert len(got) == len(ODD) and all(abs(r.score - 0.5) < 1e-6 for r in got)
    one = spark.createDataFrame([(1, 1), (2, None), (6, 1)], "doc_id long, quality int")
    net = quality_classifier.fit(odd_docs(spark), one, F.lit(True))
    assert all(r.predicted == 1 for r in quality_classifier.score(odd_docs(spark), net).collect())
    assert quality_classifier.score(odd_docs(spark).limit(0), net).count() == 0


def naive_pooled(net, row):
    """Largest response of each filter in one chunk, by plain loops over positions, bytes and lags."""
    q, best = quality_classifier, np.full(quality_classifier.FILTERS, -np.inf)
    for at in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
        z = net.p["b"].astype(float)
        for k in range(q.WIDTH):
            z = z + net.p["t"][k][row[at + k]]
        for i, lag in enumerate(q.LAGS):
            span = range(max(0, at + q.WIDTH - q.SPAN), at + q.WIDTH)
            z = z + net.p["u"][i] * sum(j >= lag and row[j] == row[j - lag] > 0 for j in span) / q.SPAN
        best = np.maximum(best, z)
    return np.maximum(best, 0)


def test_quality_score_equals_a_naive_convolution():
    rng = random.Random(1)
    net = quality_classifier.Network()
    net.p["w"][:] = np.random.default_rng(2).normal(0, 0.5, net.p["w"].size)
    net.p["c"][:] = 0.1
    for text in (b"", b"abc", b"ab" * 200, bytes(rng.randrange(256) for _ in range(700)), "né 日本 ".encode() * 40):
        rows = np.array([naive_pooled(net, r.astype(int)) for r in quality_classifier.chunks(text)])
        want = net.probability(rows.mean(axis=0), rows.max(axis=0))
        assert abs(net.score(text) - want) < 1e-5 and abs(net.score_batch([text, b"x"])[0] - want) < 1e-5


def test_first_training_step_follows_the_gradient():
    """The first Adam step moves every parameter against the sign of its derivative by differences."""
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcdefgh ", k=rng.randint(5, 600))) for _ in range(8)]  # no two chunks tie
    y = np.array([1, 0, 0, 1, 0, 0, 1, 0])
    weight = np.where(y == 1, y.size / (2 * y.sum()), y.size / (2 * (y.size - y.sum())))

    def start():
        net = quality_classifier.Network()
        net.p["w"][:] = np.random.default_rng(11).normal(0, 0.2, net.p["w"].size)
        return net

    def loss(net):
        p = np.array([net.score(t) for t in texts])
        return float((-weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean() + 5e-5 * (net.p["w"] ** 2).sum())

    trained = quality_classifier.Network()
    trained.fit(texts, y.tolist(), epochs=1)
    checked = 0
    for name in ("w", "c", "b", "u", "t"):
        places = [(2, ord(c) + 1, f) for c in "abcz" for f in range(4)] if name == "t" else list(np.ndindex(start().p[name].shape))[:40]
        for place in places:
            low, high, step = start(), start(), 2e-3
            low.p[name][place] -= step
            high.p[name][place] += step
            slope = (loss(high) - loss(low)) / (2 * step)
            if abs(slope) > 2e-3:
                checked += 1
                assert np.sign(start().p[name][place] - trained.p[name][place]) == np.sign(slope), (name, place, slope)
    assert checked > 30
