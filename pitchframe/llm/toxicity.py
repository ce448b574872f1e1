"""Toxicity: Levenshtein automata meet a lexicon trie, context windows weigh each hit.

*Lexicon.* Document frequencies of words and word stems in toxic and other labelled training rows
are counted by Spark; terms whose association with the label is far beyond chance (log-likelihood
ratio over ``MIN_EVIDENCE``) enter the lexicon with their log-odds as weight, all of them and of any
length. A stem enters where several different words continue it.

*Matching.* Each new word is run once through the lexicon trie together with its Levenshtein
automaton: a trie node is entered only while the automaton's row still holds a distance within the
limit of ``edits`` (none for short terms, one from 5 letters, two from 9). Of edits + 1 parts of a term
one must be intact, so only small tries of terms that share a part with the word are walked. Misspelled hits of a
term count only if they are rare in training rows that are not toxic.

*Context.* Every hit is weighed by the words around it: quotation marks and words of reporting
lower it, the second person and other hits near by raise it. A logistic model of five numbers per
document (weighed hits, exact hits, misspelled hits, density, length) gives the score.

Fitted on at most about ``MAX_TRAINING_ROWS`` labelled rows chosen by a hash of the id; whole texts
are read in training and scoring. Defined results: a null text is empty, has no hits and gets the
score of a text without hits; without training rows of both kinds the lexicon is empty and every
score is 0; repeated rows and null ids get a row each; rows with a null label are not learned
from; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import materialise, narrow

MAX_TRAINING_ROWS = 12_000
#: Toxic training rows that must hold a term.
MIN_DOCUMENTS = 4
#: Log-likelihood ratio a term needs: some ten thousand candidates are tested at once.
MIN_EVIDENCE = 12.0
MIN_ODDS = 3.0
STEMS = range(4, 9)
#: A stem's documents are at least this many times those of its commonest continuation.
BRANCHING = 1.3
MAX_CLEAN_RATE = 0.002
WINDOW = 5
CACHE = 400_000
EDGES = re.compile(r"^\W+|\W+$")
OPENING, CLOSING = "\"“„«‘‚'", "\"”“»’‘'"

# Words of reporting and of address in English, German, French and Spanish.
REPORTING = set("said says called calling quote quoted wrote word words term insult insults sagte nannte "
                "zitat wort dit appelé citation mot dijo llamó cita palabra".split())
ADDRESS = set("you your you're u ur du dich dir dein deine ihr euch tu toi vous ton votre tú tu usted eres".split())


def plain(token: str) -> str:
    return EDGES.sub("", token)


def edits(size: int) -> int:
    """Edits allowed in a term of that many letters."""
    return 0 if size < 5 else 1 if size < 9 else 2


@dataclass
class Lexicon:
    """Whole words and stems with their weights, and the trie the automata run on."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Terms whose misspellings count.
    fuzzy: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.trie: dict = {}
        #: Small tries of the terms of one length that share a part; of k + 1 parts one is intact.
        self.parts: dict[tuple[int, str, str], dict] = {}
        self.sizes: set[int] = set()
        for term in self.words:
            if term not in self.fuzzy or not edits(len(term)):
                continue
            size = len(term)
            part = size // (edits(size) + 1)
            self.sizes.add(size)
            shared = [(size, "head", term[:part]), (size, "tail", term[-part:])]
            if edits(size) == 2:
                shared.append((size, "middle", term[part:-part]))
            for node in (self.trie, *(self.parts.setdefault(x, {}) for x in shared)):
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = term

    def __reduce__(self):
        # tries are as deep as the longest term; they are built again where the lexicon arrives
        return Lexicon, (self.words, self.stems, self.fuzzy)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term; exact words first, then stems, then misspellings."""
        if word in self.words:
            return word, 0
        for n in STEMS:
            if word[:n] in self.stems and len(word) > n:
                return word[:n], 0
        tries = self.near(word)
        return self.nearest(word, tries) if tries else None

    def near(self, word: str) -> list[dict]:
        """Tries of the terms of a length within the limit that share an intact part with the word."""
        out = []
        for size in range(len(word) - 2, len(word) + 3):
            if size not in self.sizes or abs(size - len(word)) > edits(size):
                continue
            part = size // (edits(size) + 1)
            keys = {(size, "head", word[:part]), (size, "tail", word[-part:])}
            if edits(size) == 2:  # two edits before the middle part move it by two at most
                keys |= {(size, "middle", word[i:i + size - 2 * part]) for i in range(part - 2, part + 3)}
            out += [self.parts[k] for k in keys if k in self.parts]
        return out

    def nearest(self, word: str, tries: list[dict] | None = None) -> tuple[str, int] | None:
        """Intersect the word's Levenshtein automaton with tries (all terms); smallest edits, then term.

        The automaton's state is the band of 2 * most + 1 distances around the diagonal: at trie depth
        d, ``row[k]`` is the distance of the term's first d letters to the word's first d + k - most."""
        best: tuple[int, str] | None = None
        most, far = (2 if len(word) >= 7 else 1), 9  # terms of two edits have nine letters
        size = len(word)
        first = [k - most if most <= k <= most + size else far for k in range(2 * most + 1)]
        todo = [(trie, 0, first) for trie in ([self.trie] if tries is None else tries)]
        while todo:
            node, depth, row = todo.pop()
            if "" in node and abs(size - depth) <= most:
                found = row[size - depth + most]
                if found <= edits(depth):
                    best = min(best or (far, ""), (found, node[""]))
            for c, child in node.items():
                if c == "":
                    continue
                new, left = [], far
                for k in range(2 * most + 1):
                    i = depth + 1 + k - most  # letters of the word
                    if not 0 <= i <= size:
                        left = far
                    else:
                        left = min(left + 1, (row[k + 1] if k < 2 * most else far) + 1,
                                   row[k] + (word[i - 1] != c) if i else far)
                    new.append(left)
                if min(new) <= most:
                    todo.append((child, depth + 1, new))
        return (best[1], best[0]) if best else None


class Scanner:
    """Finds hits in whole texts; every word is matched once and remembered."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: set[str] = set()
        self.hot: dict[str, tuple[str, int]] = {}

    def hits(self, text: str) -> tuple[int, list[tuple[str, int, float]]]:
        """Number of words, and (term, edits, context weight) of each hit."""
        tokens = text.lower().split()
        distinct = set(tokens)
        fresh = distinct - self.seen
        if len(self.seen) > CACHE:
            self.seen = set(self.hot)
        for t in fresh:
            if (m := self.lexicon.match(plain(t))) is not None:
                self.hot[t] = m
        self.seen |= fresh
        if self.hot.keys().isdisjoint(distinct):
            return len(tokens), []
        at = [i for i, t in enumerate(tokens) if t in self.hot]
        return len(tokens), [(*self.hot[tokens[i]], context(tokens, i, at)) for i in at]


def _marks(token: str) -> tuple[bool, bool]:
    """Whether a quotation opens, and whether one closes, at this token (a lone mark may do either)."""
    bare = token.rstrip(".,;:!?")
    return token[0] in OPENING, bare != "" and bare[-1] in CLOSING


def quoted(tokens: list[str], i: int) -> bool:
    """Whether word ``i`` stands inside a pair of quotation marks whose ends are within the window: one
    that opens before or at it, is not closed before it, and closes at or after it before another opens."""
    inside = False
    for t in tokens[max(0, i - WINDOW):i]:
        opens, closes = _marks(t)
        if opens or closes:
            inside = not inside if opens and closes and len(t.rstrip(".,;:!?")) == 1 else opens and not closes
    if not (inside or _marks(tokens[i])[0]):
        return False
    for j, t in enumerate(tokens[i:i + WINDOW + 1]):
        opens, closes = _marks(t)
        if closes and not (opens and j and len(t.rstrip(".,;:!?")) > 1):
            return True
        if opens and j:
            return False
    return False


def context(tokens: list[str], i: int, hits: list[int]) -> float:
    """Weight of the hit at word ``i`` from the window around it."""
    weight = 1.0
    near = tokens[max(0, i - WINDOW):i + WINDOW + 1]
    if quoted(tokens, i):
        weight *= 0.4
    bare = {plain(t) for t in near}
    if bare & REPORTING:
        weight *= 0.5
    if bare & ADDRESS:
        weight *= 1.25
    if any(j != i and abs(j - i) <= WINDOW for j in hits):
        weight *= 1.25
    return weight


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, is_stem, toxic, clean): documents that hold a word or stem, by label; the term "" counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = {w for w in map(plain, set((text.as_py() or "").lower().split())) if w}
                terms = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n} | {""}
                counts[1 if label == 1 else 0].update(terms)
            terms = list(counts[1].keys() | counts[0].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                 pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    return (rows.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms strongly tied to the label, from rows (text, label)."""
    counts = _term_counts(rows)
    total = counts.filter("term = ''").collect()
    if not total or not total[0]["toxic"] or not total[0]["clean"]:
        return Lexicon()
    n1, n0 = total[0]["toxic"], total[0]["clean"]
    a, b = F.col("toxic"), F.col("clean")
    p, q = F.lit(n1 / (n1 + n0)), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # log-likelihood ratio of the label given the term, and the smoothed log-odds
    llr = a * F.log(q / p) + F.when(b > 0, b * F.log((1 - q) / (1 - p))).otherwise(0.0)
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    seen = materialise(counts.filter((F.col("term") != "") & (a >= MIN_DOCUMENTS)), "toxic-terms")
    # the commonest continuation of each stem, longer stem or word
    bare = F.regexp_replace("term", r"\*$", "")
    longest = (seen.select("toxic", F.explode(F.array(*[
        F.when(F.length(bare) > n, F.concat(F.substring(bare, 1, n), F.lit("*"))) for n in STEMS])).alias("term"))
        .filter(F.col("term").isNotNull()).groupBy("term").agg(F.max("toxic").alias("longest")))
    good = {r["term"]: r["odds"] for r in seen.filter((llr >= MIN_EVIDENCE) & (odds >= MIN_ODDS))
            .join(longest, "term", "left")
            .filter(~F.col("term").endswith("*") | (a >= BRANCHING * F.coalesce("longest", F.lit(0))))
            .select("term", odds.alias("odds")).collect()}
    stems: dict[str, float] = {}
    for t, odds in sorted(((t, x) for t, x in good.items() if t.endswith("*")), key=lambda x: (len(x[0]), x[0])):
        bare = t[:-1]
        if not any(bare[:n] in stems for n in STEMS if n <= len(bare)):
            stems[bare] = odds
    # words a stem covers stay: their misspellings need not begin with it
    words = {t: stems.get(t, odds) for t, odds in sorted(good.items()) if not t.endswith("*")}
    return Lexicon(words, stems, set(words))


NUMBERS = 5


def numbers(n_words: int, hits: list[tuple[str, int, float]], weight: dict[str, float]) -> list[float]:
    """The five numbers of a document."""
    exact = sum(c for _, d, c in hits if d == 0)
    near = sum(c for _, d, c in hits if d)
    total = sum(weight[t] / 5 * c * (1.0 if d == 0 else 0.7) for t, d, c in hits)
    return [min(total, 4.0), math.log1p(exact), math.log1p(near),
            min(20 * total / max(n_words, 1), 2.0), math.log1p(n_words) / 10]


@dataclass
class Model:
    lexicon: Lexicon
    coef: np.ndarray  # NUMBERS + 1 values, the last is the constant

    def __post_init__(self) -> None:
        self.weight = self.lexicon.words | self.lexicon.stems

    def score(self, n_words: int, hits: list[tuple[str, int, float]]) -> float:
        if not self.weight:
            return 0.0
        z = float(np.dot(self.coef[:-1], numbers(n_words, hits, self.weight)) + self.coef[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for a ridge logistic model that leans on positive weights for hits."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([1.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    ridge = np.array([0.5, 0.5, 0.5, 0.5, 0.5, 1e-3])
    w = prior.copy()
    w[-1] = -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, marks: DataFrame, usable: Column, label: str = "toxic",
        max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and logistic model from labelled rows for which ``usable`` holds."""
    chosen = marks.filter(usable & F.col(label).isNotNull()).select(id_col, F.col(label).cast("int").alias("label"))
    n = chosen.count()
    if n > max_rows:
        chosen = chosen.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < math.floor(max_rows / n * (1 << 20)))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(chosen, id_col)
    lexicon = learn_lexicon(rows)
    if not lexicon.words and not lexicon.stems:
        return Model(lexicon, np.zeros(NUMBERS + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            found = [scanner.hits(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), batch.column(1),
                 pa.array([[t for t, _, _ in h] for _, h in found], pa.list_(pa.string())),
                 pa.array([[d for _, d, _ in h] for _, h in found], pa.list_(pa.int32())),
                 pa.array([[c for _, _, c in h] for _, h in found], pa.list_(pa.float64()))],
                names=["n", "label", "terms", "edits", "contexts"])

    seen = rows.select("text", "label").mapInArrow(
        run, "n long, label int, terms array<string>, edits array<int>, contexts array<double>").collect()
    seen = sorted((r["label"], r["n"], list(zip(r["terms"], r["edits"], r["contexts"]))) for r in seen)
    clean = [h for y, _, h in seen if y != 1]
    loose = Counter(t for h in clean for t in {t for t, d, _ in h if d})
    lexicon = Lexicon(lexicon.words, lexicon.stems,
                      {t for t in lexicon.words if loose[t] <= MAX_CLEAN_RATE * max(len(clean), 1)})
    weight = lexicon.words | lexicon.stems
    x = np.array([numbers(n, [h for h in hits if h[1] == 0 or h[0] in lexicon.fuzzy], weight) for _, n, hits in seen])
    y = np.array([1.0 if label == 1 else 0.0 for label, _, _ in seen])
    return Model(lexicon, _logistic(x, y))


def score(docs: DataFrame, model: Model, threshold: float = 0.7,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_hits, terms), one row per input row.

    The model is broadcast; its terms are bounded by the words of the training rows.
    """
    docs = narrow(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.lexicon.words, model.lexicon.stems, model.lexicon.fuzzy, model.coef))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, fuzzy, coef = shared.value
        model = Model(Lexicon(words, stems, fuzzy), coef)
        scanner = Scanner(model.lexicon)
        for batch in batches:
            s, n_hits, terms = [], [], []
            for text in batch.column(1):
                n, hits = scanner.hits(text.as_py())
                s.append(model.score(n, hits))
                n_hits.append(len(hits))
                terms.append(",".join(sorted({t for t, _, _ in hits})))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()),
                 pa.array(n_hits, pa.int64()), pa.array(terms, pa.string())],
                names=["doc_id", "score", "predicted", "n_hits", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, n_hits long, terms string")
