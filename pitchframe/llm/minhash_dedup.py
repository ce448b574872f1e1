"""Near-duplicate groups: MinHash bands propose pairs, odd sketches and full sets confirm them.

1. One pass over the texts gives each document its set of word shingles, ``BANDS * ROWS``
   MinHash values for the band keys, and an odd sketch: each of its ``SAMPLES`` smallest shingle
   hashes flips one bit of a ``SKETCH_BITS`` map, so the population count of the XOR of two maps
   estimates how many samples differ, and with it a high Jaccard similarity, precisely.
2. Documents with equal shingle sets form one class; only classes go on, so a group of exact
   copies costs one row however large it is.
3. Every class is paired with one class of each of its buckets, drawn by a hash (a pre-aggregated
   minimum). Pairs whose sketches rule the threshold out are dropped, the others are confirmed on
   the full shingle sets, and the links give components.
4. Buckets that still hold several components are gone through once more: the classes outside a
   bucket's largest component meet those of its other components, so no link between different
   texts is lost to the draw; pairs inside a component need no test, and a pair comes out of the
   smallest bucket key it shares only. Spark splits large buckets of this join (skew join).

Chance of missing a pair: at Jaccard 0.85 below 1e-7, at 0.8 below 1e-5.

Defined results: a text without words has an empty set and is linked with nothing; fewer words
than a shingle give the whole sequence as one; a null id gives its row a null component, kept;
an id with several texts gives one row each, linked by that row's text; identical rows share a
class; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import materialise, narrow

BANDS = 32
ROWS = 5
SAMPLES = 256
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: A pair is ruled out where its sketches differ by this many deviations more than the threshold allows.
DEVIATIONS = 5.0
_SIG = ("doc_id {id}, text_key long, class binary, n_shingles long, bands array<long>, "
        "sketch array<long>")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (both are what bytes methods do)."""
    return text.lower().split()


def shingles_of(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return set()
    if len(w) < width:
        return {tuple(w)}
    return set(zip(*[w[i:] for i in range(width)]))


class _Hasher:
    """Shingle hashes of whole texts; word hashes come from a running sum of byte powers."""

    def __init__(self, width: int):
        self.width = width
        rng = np.random.default_rng(20240229)
        n = BANDS * ROWS
        self.a = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.band_salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        self.step = np.uint64(0xD6E8FEB86659FD93)
        inverse = pow(int(self.step), -1, 2**64)
        self.inverse = np.uint64(inverse)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.powers = np.cumprod(np.full(n, self.step, np.uint64))
        self.inverses = np.cumprod(np.full(n, self.inverse, np.uint64))

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        raw = np.frombuffer(text.lower(), np.uint8)
        if raw.size > self.powers.size:
            self._grow(2 * raw.size)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if start.size == 0:
            return np.empty(0, np.uint64)
        sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:raw.size], out=sums[1:])
        word = _mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))
        k = min(self.width, word.size)
        h = np.full(word.size - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + word[i:word.size - k + 1 + i])
        return np.unique(h)

    def samples(self, h: np.ndarray) -> np.ndarray:
        low = (h >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.a.size, 2**32 - 1, np.uint32)
        for at in range(0, low.size, 2048):
            part = low[at:at + 2048, None] * self.a
            part += self.b
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def bands(self, best: np.ndarray) -> np.ndarray:
        rows = best.reshape(BANDS, ROWS).astype(np.uint64)
        key = self.band_salt.copy()
        for i in range(ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return key.view(np.int64)

    def sketch(self, h: np.ndarray) -> np.ndarray:
        """Parity map of the smallest hashes (``h`` is sorted; the bits come from a second mix)."""
        bit = (_mix(h[:SAMPLES] + np.uint64(0x632BE59BD9B4E019)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, class, n_shingles, bands, sketch), one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(width)
        none = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cls, n, bands, sketches = [], [], [], []
                for text in part.column(2):
                    h = hasher.shingles(text.as_py())
                    n.append(h.size)
                    cls.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    best = hasher.samples(h) if h.size else none
                    bands.append(hasher.bands(best) if h.size else none)
                    sketches.append(hasher.sketch(h) if h.size else none)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "class", "n_shingles", "bands", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(run, _SIG.format(id=kind))


def _most_apart(n_a: Column, n_b: Column, threshold: float) -> Column:
    """Bits by which the sketches of two sets of these sizes may differ at the threshold.

    There the sets share I = t / (1 + t) * (n_a + n_b) shingles. Samples keep the share ``kept`` of
    them, so d = samples of a + samples of b - 2 * kept * I samples differ; d flips of random bits
    set m / 2 * (1 - exp(-2 d / m)) of m bits on average.
    """
    m = float(SKETCH_BITS)
    kept = F.least(F.lit(1.0), SAMPLES / F.greatest(n_a, n_b))
    d = F.greatest(F.least(n_a, F.lit(float(SAMPLES))) + F.least(n_b, F.lit(float(SAMPLES)))
                   - 2 * kept * (threshold / (1 + threshold)) * (n_a + n_b), F.lit(0.0))
    d = d + F.when(kept < 1, DEVIATIONS * F.sqrt(2 * d) + DEVIATIONS).otherwise(F.lit(0.001))
    spread = F.greatest(m / 4 * (1 - F.exp(-4 * d / m)) - d * F.exp(-4 * d / m), F.lit(0.0))
    # d flips never set more than d bits: where whole sets are sampled, this bound is exact
    return F.least(d, m / 2 * (1 - F.exp(-2 * d / m)) + DEVIATIONS * F.sqrt(spread) + 1)


def _marks(classes: DataFrame, threshold: float) -> DataFrame:
    """(class, n, sketch, cap): ``cap`` is the most any partner of a possible size allows."""
    n, full = F.col("n").cast("double"), F.lit(float(SAMPLES))
    partners = [n * threshold, n, n / threshold, F.least(F.greatest(full, n * threshold), n / threshold)]
    return classes.select("class", "n", "sketch",
                          F.greatest(*[_most_apart(n, x, threshold) for x in partners]).alias("cap"))


def _close(a: str, b: str, threshold: float) -> Column:
    """Sketches and set sizes leave the threshold possible (kept short: it runs inside joins)."""
    apart = reduce(lambda x, y: x + y, [
        F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_WORDS)])
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return ((F.least(n_a, n_b) >= F.greatest(n_a, n_b) * F.lit(threshold - 0.001))
            & (apart <= F.least(F.col(f"{a}.cap"), F.col(f"{b}.cap"))))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes with 100 * intersection >= percent * union of full shingle sets."""
    # the text of every class in a pair, once: a repeated row adds no pair
    asked = pairs.select(F.col("u").alias("class")).union(pairs.select(F.col("v").alias("class"))).distinct()
    place = classes.select("class", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("k")).join(asked, "class")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), F.col("text").cast("binary").alias("t"))
    text = materialise(texts.join(place, ["d", "k"]).groupBy("class").agg(F.first("t").alias("t")), "pair-texts")
    p = pairs
    for side in ("u", "v"):
        p = p.join(text.select(F.col("class").alias(side), F.col("t").alias(f"t_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, set] = {}

        def of(cls: bytes, text: pa.Scalar) -> set:
            if cls not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[cls] = shingles_of(text.as_py(), width)
            return kept[cls]

        for batch in batches:
            us, vs = [], []
            for u, v, tu, tv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    batch.column(2), batch.column(3)):
                a, b = of(u, tu), of(v, tv)
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())],
                                             names=["u", "v"])

    return p.select("u", "v", "t_u", "t_v").mapInArrow(run, "u binary, v binary")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of all nodes of ``links`` (u, v): the smallest node that is reachable.

    Smallest-label spreading with pointer jumping; each round is written to the shared folder.
    """
    both = materialise(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
                       .distinct(), f"{name}-both")
    label = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c"))
                        .select(F.col("u").alias("node"), "c"), f"{name}-label")
    while True:
        seen = both.join(label.select(F.col("node").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
        step = (label.join(seen.withColumnRenamed("u", "node"), "node")
                .select("node", F.col("c").alias("old"), F.least("c", "near").alias("c")))
        root = label.select(F.col("node").alias("c"), F.col("c").alias("up"))
        step = materialise(step.join(root, "c", "left").select(
            "node", "old", F.least("c", F.coalesce("up", "c")).alias("c")), f"{name}-step")
        label = step.select("node", "c")
        if step.filter(F.col("old") != F.col("c")).isEmpty():
            return label.withColumnRenamed("c", "component")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, class): one row per class and band."""
    return classes.select("class", F.explode("bands").alias("bucket"))


def _mixed(placed: DataFrame) -> DataFrame:
    """(bucket, main) of the buckets with several components; ``main`` holds the most classes."""
    counted = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    return (counted.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"),
                                          F.count("*").alias("kinds"))
            .filter("kinds > 1").select("bucket", "main"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row."""
    docs = narrow(docs, id_col, text_col)
    threshold = percent / 100
    sig = materialise(signatures(docs, width), "signatures")
    usable = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(
        usable.groupBy("class").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    marks = _marks(classes, threshold)

    def close_pairs(pairs: DataFrame) -> DataFrame:
        return (pairs.join(marks.select(F.col("class").alias("u"), F.struct("n", "sketch", "cap").alias("a")), "u")
                .join(marks.select(F.col("class").alias("v"), F.struct("n", "sketch", "cap").alias("b")), "v")
                .filter(_close("a", "b", threshold)).select("u", "v"))

    # every class with the class drawn in each of its buckets
    drawn = F.struct(F.xxhash64("bucket", "class").alias("by"), "class")
    shared = materialise(_buckets(classes).groupBy("bucket").agg(
        F.min(drawn)["class"].alias("pivot"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = materialise(_buckets(classes).join(shared, "bucket"), "members")
    star = materialise(members.filter(F.col("class") != F.col("pivot")).select(
        F.least("pivot", "class").alias("u"), F.greatest("pivot", "class").alias("v")).distinct(), "star")
    links = materialise(confirm(close_pairs(star), classes, docs, width, percent).distinct(), "links")
    comp = components(links)

    # buckets that still hold several components: the classes outside the largest one against the rest
    placed = materialise(members.join(comp.withColumnRenamed("node", "class"), "class", "left").select(
        "bucket", "class", F.coalesce("component", "class").alias("component")), "placed")
    mixed = materialise(_mixed(placed), "mixed")
    crowd = materialise(placed.join(mixed, "bucket").join(marks.join(classes.select("class", "bands"), "class"), "class"),
                        "crowd")
    a, b = crowd.filter(F.col("component") != F.col("main")).alias("a"), crowd.alias("b")
    across = (a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component"))
                     & ((F.col("b.component") == F.col("b.main")) | (F.col("a.class") < F.col("b.class")))
                     & _close("a", "b", threshold)
                     & (F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.bucket")))
              .select(F.least("a.class", "b.class").alias("u"), F.greatest("a.class", "b.class").alias("v"))
              .distinct().join(star, ["u", "v"], "left_anti"))
    more = materialise(confirm(materialise(across, "across"), classes, docs, width, percent).distinct(), "more")
    if not more.isEmpty():
        comp = components(links.union(more))

    # the smallest id of each component, then back to the rows
    named = classes.join(comp.withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.col("first.doc_id").alias("rep"), F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = materialise(named.join(least, "component").select("class", "component_id"), "of-class")
    out = sig.select("doc_id", "n_shingles", F.when(
        (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    out = out.join(of_class, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
