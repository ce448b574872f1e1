"""Ranked lexical search: an Aho-Corasick automaton of all item terms counts tf straight from the texts.

No index of the documents is built. A text's bytes are mapped once (A-Z to a-z, every byte that is in
no term to a space) and walked by an automaton whose words are the item terms between two spaces, the
guards that make a match a whole term. Two scans of the documents:

1. each task adds up the documents with a term (N), all terms (L) and, for each item term, the
   documents that hold it (df): one fixed-size array a task, added up in a tree;
2. each task counts tf again, adds every found term's contribution to the items it belongs to (the
   automaton's outputs map to items) and keeps the best ``k`` documents of each item; a window over
   these few rows gives the ranks.

The automaton is broadcast; items go in slices of about ``SLICE_CHARS`` characters of item text, chosen
by a hash, so its size has a bound and a larger benchmark takes more scans.

Defined results: a null or empty text or item has no terms, an item without terms or without a scoring
document no rows; every row is a document (repeated rows rank side by side) and every row of ``items`` an
item (a repeated item repeats its rows); a null id ranks last among equal scores; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import narrow
from pitchframe.llm.vectors import reduced

TOP = 10
#: Characters of item text in one automaton.
SLICE_CHARS = 1 << 23
#: (document, item) additions and scores handled at once in a task.
BLOCK = 1 << 20

#: Every byte of a text as the automaton sees it: term bytes lower-cased, others a space.
GUARDED = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                for b in range(256))


def guarded(text: bytes) -> bytes:
    return text.translate(GUARDED)


class Terms:
    """The terms of some items, the automaton over them and the items each term belongs to."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        pairs = []
        for item, text in enumerate(texts):
            for term, times in Counter(guarded(text).split()).items():
                pairs.append((number.setdefault(term, len(number)), item, times))
        pairs.sort()
        self.terms = list(number)
        at, self.items, self.times = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
        self.start = np.searchsorted(at, np.arange(len(number) + 1))
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def count(self, text: bytes) -> Counter:
        """How often each term (by number) stands in a guarded text."""
        if not self.terms:
            return Counter()
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                self._automaton.add_word(f" {term.decode('latin-1')} ", i)
            self._automaton.make_automaton()
        return Counter(map(itemgetter(1), self._automaton.iter(f" {text.decode('latin-1')} ")))


class _Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least, self.rows, self.size = k, np.ones(n_items, np.int64), [], 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.rows.append(pa.table({"item": item, "score": scores[doc, item], "doc_id": ids.take(pa.array(doc))}))
        self.size += doc.size
        if self.size > 4 * self.k * self.least.size + 10_000:
            self.trim()

    def trim(self) -> pa.Table | None:
        if not self.rows:
            return None
        rows = pa.concat_tables(self.rows)
        rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"),
                                                ("doc_id", "ascending")], null_placement="at_end"))
        item = rows["item"].to_numpy()
        place = np.arange(item.size) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = rows["score"].to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k))
        self.rows, self.size = [rows], rows.num_rows
        return rows


def statistics(docs: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """N, L and df of every term, over all documents."""
    model, size = docs.sparkSession.sparkContext.broadcast(terms), len(terms.terms)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(size + 2, np.int64)
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            text = guarded(text)
            n = len(text.split())
            total[0] += n > 0
            total[1] += n
            total[2 + np.fromiter(model.value.count(text), np.int64)] += 1
        return total

    total = reduced(docs.select("text"), count, np.add, np.int64)
    if total is None:
        return 0, 0, np.zeros(size, np.int64)
    return int(total[0]), int(total[1]), total[2:]


def _slice(docs: DataFrame, names: list, texts: list[bytes], item_type, k: int) -> DataFrame:
    """Best ``k`` documents per item (slot, item_id, doc_id, score) of every task, for one slice of items."""
    terms = Terms(texts)
    n_docs, n_terms, df = statistics(docs, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    most = np.bincount(terms.items, weights=terms.times * weight[np.repeat(np.arange(weight.size), np.diff(terms.start))]
                       if terms.items.size else None, minlength=1).max() * 1e6
    model = docs.sparkSession.sparkContext.broadcast((terms, weight, names))
    n_items, exact = len(names), most < 1 << 53  # sums of doubles are exact below that

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, names = model.value
        best, lens = _Best(n_items, k), np.diff(terms.start)
        id_type = None

        def flush(found: list, ids: pa.Array) -> None:
            rows = np.repeat(np.arange(len(found)), [t.size for t, _ in found])
            number = np.concatenate([t for t, _ in found])
            gain = np.concatenate([g for _, g in found])
            each = lens[number]
            at = np.arange(each.sum()) + np.repeat(terms.start[number] - (np.cumsum(each) - each), each)
            cell = np.repeat(rows, each) * n_items + terms.items[at]
            gain = np.repeat(gain, each) * terms.times[at]
            if exact:
                scores = np.bincount(cell, weights=gain, minlength=len(found) * n_items).astype(np.int64)
            else:
                scores = np.zeros(len(found) * n_items, np.int64)
                np.add.at(scores, cell, gain)
            best.add(scores.reshape(-1, n_items), ids)

        for batch in batches:
            ids, found, first, size = batch.column(0), [], 0, 0
            id_type = ids.type
            for at, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                text = guarded(text)
                tf = terms.count(text)
                n = len(text.split())
                m = 25 + (75 * n * n_docs // n_terms if n else 0)
                number = np.fromiter(tf.keys(), np.int64, len(tf))
                times = np.fromiter(tf.values(), np.int64, len(tf))
                found.append((number, weight[number] * (1_000_000_000 * times // (1000 * times + 8 * m))))
                size += int(lens[number].sum()) + n_items
                if size >= BLOCK:
                    flush(found, ids.slice(first, at + 1 - first))
                    found, first, size = [], at + 1, 0
            if found:
                flush(found, ids.slice(first))
        rows = best.trim()
        if rows is not None and rows.num_rows:
            slot = rows["item"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [slot.cast(pa.int32()), pa.array(names, item_type).take(slot),
                 rows["doc_id"].combine_chunks().cast(id_type), rows["score"].combine_chunks()],
                names=["slot", "item_id", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"slot int, item_id {_spark_type(item_type)}, doc_id {kind}, score long")


def _spark_type(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def search(docs: DataFrame, items: DataFrame, k: int = TOP, slice_chars: int = SLICE_CHARS, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    docs = narrow(docs, id_col, text_col).withColumn("text", F.col("text").cast("string"))
    items = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slices = -(-chars // slice_chars)
    out = None
    for i in range(slices):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).toArrow()
        texts = own["text"].cast(pa.binary()).to_pylist()
        if not texts:
            continue
        found = _slice(docs, own["item_id"].to_pylist(), texts, own["item_id"].type, k)
        place = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    if out is None:
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id"))]
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return out
