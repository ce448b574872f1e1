"""Quality classifier: a byte-level convolutional network in numpy.

Input channels of a position are its byte (one-hot) and, for ``LAGS`` distances, the share of the
last ``SPAN`` bytes that repeat the byte that far back. Learned filters of ``WIDTH`` bytes run
over overlapping chunks that cover the whole text; each filter is max-pooled within a chunk, the
chunks' maxima are combined by their mean and their maximum, and a logistic layer gives one
probability. Because bytes are one-hot, a filter is a table lookup per byte and training touches
only the positions that won the pooling.

It is fitted on at most about ``MAX_TRAINING_ROWS`` labelled rows, chosen by a hash of the id;
training and scoring read whole texts. Labels, language, source and id are never inputs of a score.

Defined results: a null text is empty and is scored like an empty text; without labelled rows
every score is 0.5; rows with a null label are not learned from; repeated rows and null ids get a
row each; other columns are ignored; an empty table gives an empty result. Memory is bounded by a
block of chunks, whatever the length of a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import narrow

CHUNK = 256
HOP = 224
STRIDE = 2
WIDTH = 8
FILTERS = 16
SPAN = 16
LAGS = tuple(range(2, 26))
MAX_TRAINING_ROWS = 3_000
EPOCHS = 12
#: Chunks handled at once.
BLOCK = 512


def chunks(text: bytes) -> np.ndarray:
    """[chunks, CHUNK] byte codes 1 to 256, 0 where the text has ended; an empty text has one chunk."""
    n = max(1, math.ceil(max(len(text) - (CHUNK - HOP), 1) / HOP))
    raw = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    raw = np.pad(raw, (0, max(0, HOP * (n - 1) + CHUNK - raw.size)))
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[::HOP][:n]


def blocks(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The chunks of all rows in order, at most ``BLOCK`` at a time."""
    held: list[np.ndarray] = []
    for row in rows:
        for at in range(0, len(row), BLOCK):
            part = row[at:at + BLOCK]
            if held and sum(map(len, held)) + len(part) > BLOCK:
                yield np.concatenate(held)
                held = []
            held.append(part)
    if held:
        yield np.concatenate(held)


def channels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows [chunks, positions, WIDTH] and repeat shares [chunks, positions, LAGS]."""
    starts = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
    windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]
    late = -(-(SPAN - WIDTH) // STRIDE)  # positions before it end within the first ``SPAN`` bytes
    shares = np.empty((x.shape[0], starts.size, len(LAGS)), np.float32)
    for i, lag in enumerate(LAGS):
        same = np.zeros(x.shape, np.int16)
        np.logical_and(x[:, lag:] == x[:, :-lag], x[:, lag:] > 0, out=same[:, lag:], casting="unsafe")
        run = np.zeros((x.shape[0], CHUNK + 1), np.int16)
        np.cumsum(same, axis=1, out=run[:, 1:], dtype=np.int16)
        held = run[:, WIDTH::STRIDE].copy()
        held[:, late:] -= run[:, late * STRIDE - (SPAN - WIDTH):CHUNK + 1 - SPAN:STRIDE]
        shares[:, :, i] = held
    shares /= SPAN
    return windows, shares


class Network:
    """Filters ``t`` [WIDTH, 257, FILTERS] on bytes and ``u`` [LAGS, FILTERS] on repeats; head ``w``."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "t": rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32),
            "u": rng.normal(0, 0.3, (len(LAGS), FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "w": np.zeros(2 * FILTERS, np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.p["t"][:, 0] = 0

    def filters(self, windows: np.ndarray, shares: np.ndarray) -> np.ndarray:
        z = shares @ self.p["u"] + self.p["b"]
        for k in range(WIDTH):
            z += self.p["t"][k][windows[:, :, k]]
        return z

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """[chunks, FILTERS]: the largest response of each filter in each chunk, at least 0."""
        return np.maximum(self.filters(*channels(x)).max(axis=1), 0)

    def probability(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        z = np.concatenate([mean, top], axis=-1) @ self.p["w"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: bytes) -> float:
        x = chunks(text)
        total, top = np.zeros(FILTERS), np.zeros(FILTERS)
        for at in range(0, len(x), BLOCK):
            m = self.pooled(x[at:at + BLOCK])
            total += m.sum(axis=0)
            top = np.maximum(top, m.max(axis=0))
        return float(self.probability(total / len(x), top))

    def score_batch(self, texts: list[bytes]) -> list[float]:
        """Scores of texts that are short enough to be handled together, long ones one by one."""
        out = [0.0] * len(texts)
        held: list[int] = []
        rows: list[np.ndarray] = []

        def flush() -> None:
            if held:
                size = np.array([len(r) for r in rows])
                m = self.pooled(np.concatenate(rows))
                at = np.concatenate([[0], np.cumsum(size)[:-1]])
                mean = np.add.reduceat(m, at, axis=0) / size[:, None]
                for i, p in zip(held, self.probability(mean, np.maximum.reduceat(m, at, axis=0))):
                    out[i] = float(p)
                held.clear()
                rows.clear()

        for i, text in enumerate(texts):
            if len(text) > BLOCK * HOP:
                out[i] = self.score(text)
                continue
            rows.append(chunks(text))
            held.append(i)
            if sum(map(len, rows)) >= BLOCK:
                flush()
        flush()
        return out

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on balanced log loss, a whole text per example, in batches of 32 texts.

        Chunks are pooled in blocks; gradients flow through the positions that won the pooling, whose
        blocks are computed again where a batch has many. What is held of a batch besides its
        texts is a winner and a maximum per chunk and filter.
        """
        y = np.array(labels, np.float32)
        if y.size == 0 or y.min() == y.max():
            if y.size:
                self.p["c"][:] = 4.0 if y[0] else -4.0
            return
        weight = np.where(y == 1, y.size / (2 * y.sum()), y.size / (2 * (y.size - y.sum()))).astype(np.float32)
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.p["w"][:] = rng.normal(0, 0.2, 2 * FILTERS)
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(y.size)
            for at in range(0, y.size, 32):
                pick = order[at:at + 32]
                rows = [chunks(texts[i]) for i in pick]
                size = np.array([len(r) for r in rows])
                owner = np.repeat(np.arange(len(rows)), size)
                # the channels of a few blocks are kept, those of more are computed again
                few = size.sum() <= 4 * BLOCK
                wins, maxima, kept = [], [], []
                for x in blocks(rows):
                    windows, shares = channels(x)
                    if few:
                        kept.append((windows, shares))
                    z = self.filters(windows, shares)
                    wins.append(z.argmax(axis=1).astype(np.uint8))
                    maxima.append(z.max(axis=1))
                best, m = np.concatenate(wins), np.concatenate(maxima)
                live = m > 0
                m = np.maximum(m, 0)
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                mean = np.add.reduceat(m, start, axis=0) / size[:, None]
                top = np.maximum.reduceat(m, start, axis=0)
                p = self.probability(mean, top)
                d = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                w = self.p["w"]
                dm = d[owner, None] * w[:FILTERS] / size[owner, None]
                dm = dm + np.where(m == top[owner], d[owner, None] * w[FILTERS:], 0)
                dm = np.where(live, dm, 0).astype(np.float32)
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["w"] = (np.concatenate([mean, top], axis=1) * d[:, None]).sum(axis=0) + 1e-4 * w
                g["c"] = np.array([d.sum()], np.float32)
                g["b"] = dm.sum(axis=0)
                done = 0
                for i, x in enumerate(blocks(rows)):
                    windows, shares = kept[i] if few else channels(x)
                    own = dm[done:done + len(x)]
                    r, f = np.nonzero(own)
                    won = best[done:done + len(x)][r, f]
                    np.add.at(g["u"].T, f, shares[r, won] * own[r, f][:, None])
                    for k in range(WIDTH):
                        np.add.at(g["t"][k], (windows[r, won, k], f), own[r, f])
                    done += len(x)
                g["t"][:, 0] = 0
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for k in self.p:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.99 * second[k] + 0.01 * g[k] * g[k]
                    self.p[k] -= (rate * first[k] / (1 - 0.9 ** step)
                                  / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)


def training_rows(docs: DataFrame, marks: DataFrame, label: str, usable, max_rows: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of about ``max_rows`` labelled rows for which ``usable`` holds, by a hash of the id."""
    rows = marks.filter(usable & F.col(label).isNotNull()).select(id_col, label)
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < math.floor(max_rows / n * (1 << 20)))
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.join(rows, id_col).select("text", F.col(label).cast("int").alias("label"))


def fit(docs: DataFrame, marks: DataFrame, usable, label: str = "quality",
        max_rows: int = MAX_TRAINING_ROWS) -> Network:
    """A network fitted on the driver from the whole texts of a bounded sample of rows."""
    rows = training_rows(docs, marks, label, usable, max_rows).select(
        F.col("text").cast("binary").alias("text"), "label").collect()
    rows = sorted((bytes(r["text"]), r["label"]) for r in rows)
    net = Network()
    net.fit([r[0] for r in rows], [r[1] for r in rows])
    return net


def score(docs: DataFrame, net: Network, threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per input row; the network (under 1 MB) is broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)
    docs = narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = net.score_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                    names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int")


def keep(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least ``threshold``, all columns; no join."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network()
        net.p = model.value
        for texts in batches:
            texts = [bytes(t) for t in texts]
            yield pd.Series([s >= threshold for at in range(0, len(texts), 256)
                             for s in net.score_batch(texts[at:at + 256])], dtype=bool)

    good = F.pandas_udf(run, "boolean")
    return docs.filter(good(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
