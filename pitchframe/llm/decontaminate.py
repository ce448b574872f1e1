"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. An item's rare word n-grams, those that stand in at most ``RARE_ITEMS`` different items, are its seeds,
   however many documents hold them: what an edited or partial copy still shares with its item is
   found in one document as in a million. An item with fewer than ``MIN_SEEDS`` of them takes its
   ``MIN_RARE`` rarest n-grams. What many items share (a template) is no evidence of a copy of
   any of them and costs nothing. Items with the same words are one.
2. One pass joins seeds to whole texts and clusters the hits of an item into windows. Windows that
   hold too few of the item's words for the score asked for are left out (an upper bound of the
   score, so nothing is lost).
3. Each other window is aligned with the item word by word (local alignment with gaps). The alignment
   score as a share of the item's own score finds exact, edited and paraphrased copies.

The benchmark side is looked up in memory by every task, so it is handled in slices of bounded
size (``SLICE_BYTES`` of item text); a larger benchmark costs more passes, not more memory.

Defined results: a null text has no words; items that are null or have fewer words than a seed
match nothing; repeated items or documents give a row each; null ids are passed on; other columns
are ignored; empty tables give an empty result. Long texts are handled one at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pitchframe.llm.common import kept, narrow

SEED = 3
MIN_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.4
RARE_ITEMS = 8
MIN_RARE = 6
SLICE_BYTES = 32 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of any other non-ASCII characters."""
    return text.translate(_LOWER).split()


class Benchmark:
    """Items as word numbers, their n-grams, and where each n-gram stands."""

    def __init__(self, items: list[bytes]):
        self.word: dict[bytes, int] = {}
        equal: dict[tuple, list[int]] = {}
        for i, t in enumerate(items):
            equal.setdefault(tuple(self.word.setdefault(w, len(self.word)) for w in words_of(t)), []).append(i)
        self.items = [np.array(ids, np.int64) for ids in equal]
        self.named = list(equal.values())  # the items given that have these words
        base = len(self.word) + 1
        self.base = np.int64(base)
        keys, owner, place = [], [], []
        for i, ids in enumerate(self.items):
            k = self.keys(ids)
            keys.append(k)
            owner.append(np.full(k.size, i))
            place.append(np.arange(k.size))
        key, owner, place = (np.concatenate(x) if keys else np.empty(0, np.int64) for x in (keys, owner, place))
        rare = self._rare(key, owner)
        key, owner, place = key[rare], owner[rare], place[rare]
        order = np.argsort(key, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bags = [np.unique(ids, return_counts=True) for ids in self.items]

    @staticmethod
    def _rare(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which n-grams are seeds: those of few items; of an item with fewer than ``MIN_SEEDS`` such, its
        ``MIN_RARE`` rarest."""
        gram, number = np.unique(key, return_inverse=True)
        pair = np.unique(number * (int(owner.max(initial=0)) + 1) + owner)
        n_items = np.bincount(pair // (int(owner.max(initial=0)) + 1), minlength=gram.size)[number]
        order = np.lexsort((n_items, owner))
        place = np.empty(key.size, np.int64)  # of a gram among its item's, rarest first
        place[order] = np.arange(key.size) - np.searchsorted(owner[order], owner[order])
        rare = n_items <= RARE_ITEMS
        few = np.bincount(owner, weights=rare, minlength=1) < MIN_SEEDS
        return rare | (few[owner] & (place < MIN_RARE))

    def keys(self, ids: np.ndarray) -> np.ndarray:
        n = max(ids.size - SEED + 1, 0)
        key = np.zeros(n, np.int64)
        for i in range(SEED):  # may wrap: the alignment settles what a wrapped key brings in
            key = key * self.base + ids[i:i + n]
        return key

    def hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of the text (-1: not in any item), and gram numbers and positions of hits."""
        word = self.word
        ids = np.array([word.get(w, -1) for w in words_of(text)], np.int64)
        n = max(ids.size - SEED + 1, 0)
        if not n or not self.grams.size:
            return ids, np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids >= 0
        whole = known[:n].copy()
        for i in range(1, SEED):
            whole &= known[i:i + n]
        at = np.flatnonzero(whole)
        key = np.zeros(at.size, np.int64)
        for i in range(SEED):
            key = key * self.base + ids[at + i]
        g = np.minimum(np.searchsorted(self.grams, key), self.grams.size - 1)
        hit = self.grams[g] == key
        return ids, g[hit], at[hit]

    def shared(self, text: np.ndarray, i: int) -> int:
        """How many words of item ``i`` the text holds, each as often as both do."""
        own, n = self.bags[i]
        at = np.minimum(np.searchsorted(own, text), own.size - 1)
        return int(np.minimum(np.bincount(at[own[at] == text], minlength=own.size), n).sum())

    def need(self, i: int) -> int:
        """Different hits a window needs; few-seeded items (short ones) need fewer."""
        return min(MIN_SEEDS, max(1, self.items[i].size - SEED))

    def matches(self, text: bytes, min_score: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, seeds, first word, last word) of the best alignment of each item found."""
        ids, gram, at = self.hits(text)
        if not gram.size:
            return []
        n = self.count[gram]
        rows = np.repeat(self.first[gram] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, pos, place = self.owner[rows], np.repeat(at, n), self.place[rows]
        # an item with too few different hits in the whole text has too few in any window
        distinct = np.unique(np.stack([item, place]), axis=1)[0]
        found, many = np.unique(distinct, return_counts=True)
        enough = np.array([c >= self.need(i) for i, c in zip(found.tolist(), many.tolist())])
        keep = np.isin(item, found[enough])
        item, pos, place = item[keep], pos[keep], place[keep]
        order = np.lexsort((pos, item))
        item, pos, place = item[order], pos[order], place[order]
        out = []
        cut = np.flatnonzero(np.diff(item)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), item.size]):
            if hi == lo:
                continue
            i = int(item[lo])
            length = self.items[i].size
            need = self.need(i)
            best: tuple[float, int, int, int] | None = None
            ends = np.flatnonzero(np.diff(pos[lo:hi]) > length) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), hi - lo]):
                seeds = np.unique(place[lo + a:lo + b]).size
                if seeds < need:
                    continue
                start = max(0, int(pos[lo + a]) - length)
                end = min(ids.size, int(pos[lo + b - 1]) + SEED + length)
                # a score cannot exceed the share of the item's words that stand in the window
                if self.shared(ids[start:end], i) / length < min_score:
                    continue
                score, x, y = align(ids[start:end], self.items[i])
                score /= MATCH * length
                if score >= min_score and (best is None or score > best[0]):
                    best = (score, seeds, start + x, start + y)
            if best is not None:
                out.append((i, *best))
        return out


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: best local score, and the first and last aligned word of the text.

    One row per item word; gaps along the text are a running maximum, so a row is a few array
    operations. The start of the best alignment travels with the scores.
    """
    n = text.size
    slope = -GAP * np.arange(n + 1)
    row, start = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        new, begin = np.zeros(n + 1), np.arange(n + 1)
        take = diagonal >= up
        score = np.where(take, diagonal, up)
        live = score > 0
        new[1:] = np.where(live, score, 0)
        begin[1:] = np.where(live, np.where(take, start[:-1], start[1:]), begin[1:])
        lifted = new + slope
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= run, np.arange(n + 1), 0))
        row, start = run - slope, begin[source]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (float(row[top]), int(start[top]), top - 1)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, slice_bytes: int = SLICE_BYTES,
          id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, last_word): a row per document and item it copies."""
    docs = narrow(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, score double, n_seeds long, first_word long, last_word long"

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, names = _opened(shared)
            for batch in batches:
                found = [(at, i, *m[1:]) for at, t in enumerate(batch.column(1))
                         for m in b.matches(t.as_py(), min_score) for i in b.named[m[0]]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                     pa.array([names[f[1]] for f in found], item_arrow),
                     pa.array([f[2] for f in found], pa.float64()),
                     *[pa.array([f[k] for f in found], pa.int64()) for k in (3, 4, 5)]],
                    names=["doc_id", "item_id", "score", "n_seeds", "first_word", "last_word"])
        return find

    parts = [docs.mapInArrow(finder(x), schema) for x in _sliced(items, slice_bytes)]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, slice_bytes: int = SLICE_BYTES,
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that copy no item, all columns; decided where the text is read, without a join."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))

    def copies(shared):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            b, _ = _opened(shared)
            for texts in batches:
                yield pd.Series([bool(b.matches(bytes(t), min_score)) for t in texts], dtype=bool)
        return F.pandas_udf(run, "boolean")

    for x in _sliced(items, slice_bytes):
        docs = docs.filter(~copies(x)(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return docs


def _opened(shared: Broadcast) -> tuple[Benchmark, list]:
    key, texts, names = shared.value
    return kept(("benchmark", key), lambda: Benchmark(texts)), names


def _sliced(items: DataFrame, slice_bytes: int) -> list[Broadcast]:
    """The benchmark (texts, ids) in slices of bounded size."""
    sc = items.sparkSession.sparkContext
    items = items.filter(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    slices = max(1, math.ceil(total / slice_bytes))
    out = []
    for k in range(slices):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        rows = sorted(((bytes(r["t"]), r["item_id"]) for r in
                       own.select("item_id", F.col("text").cast("binary").alias("t")).collect()),
                      key=lambda r: (r[0], str(r[1])))
        out.append(sc.broadcast((uuid.uuid4().hex, [t for t, _ in rows], [n for _, n in rows])))
    return out
