"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (1 to 4 characters of the lower-cased letters and the gaps between
them) are summed per language by Spark over the training rows; the smoothed log-probability
matrix (``2**BITS`` buckets by languages, a size fixed by parameters and the number of languages)
is broadcast, and whole texts are scored in numpy by gathering its rows for the n-grams of a
whole batch and summing them per text.

Training uses at most about ``MAX_TRAINING_ROWS`` rows, chosen by a hash of the id so that the
choice is the same in every run.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
training row every text is ``und``; repeated rows and null ids get a row each; rows with a null
language are never learned from; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
SIZES = (1, 2, 3, 4)
MAX_TRAINING_ROWS = 100_000
#: Characters of the texts handled at once.
CHUNK = 1 << 18
UNKNOWN = "und"


def features(text: str, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Hashed n-grams of one text, of ``chunk`` characters at a time; every run of non-letters counts as one
    gap character. Each n-gram comes once, with the piece its last character lies in."""
    text, before, after_letter = text.lower(), np.empty(0, np.uint64), False
    for at in range(0, len(text), chunk):
        code = np.frombuffer(text[at:at + chunk].encode("utf-32-le"), np.uint32)
        letter = _letters(code)
        keep = letter | np.concatenate([[after_letter], letter[:-1]])  # the first non-letter of each run
        after_letter = bool(letter[-1])
        code = np.concatenate([before, np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)])
        out, known = [], before.size
        h = np.zeros(code.size, np.uint64)
        for n in range(1, max(SIZES) + 1):
            if code.size < n:
                break
            h = h[:code.size - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(n)
            if n in SIZES:
                new = h[max(known - n + 1, 0):]
                mixed = (new ^ (new >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
        before = code[max(code.size - max(SIZES) + 1, 0):]
        yield np.concatenate(out) if out else np.empty(0, np.int32)


_TABLE: list[np.ndarray] = []


def _letters(code: np.ndarray) -> np.ndarray:
    """True for letters, by a table over the basic plane; others are asked one by one."""
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    letter = _TABLE[0][np.minimum(code, 0xFFFF)]
    beyond = np.flatnonzero(code > 0xFFFF)
    for i in beyond.tolist():
        letter[i] = chr(code[i]).isalpha()
    return letter


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang",
        id_col: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix [2**BITS, languages]) from rows with a language."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.floor(max_rows / n * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if lang not in counts:
                    counts[lang], docs[lang] = np.zeros(1 << BITS, np.int64), 0
                for f in features(text.as_py()):
                    counts[lang] += np.bincount(f, minlength=1 << BITS)
                docs[lang] += 1
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (at.size + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()),
                 pa.array(np.append(c[at], docs[lang]), pa.int64())], names=["lang", "bucket", "n"])

    counted = (rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counted["lang"].unique())
    matrix = np.zeros((1 << BITS, len(langs)))
    for i, lang in enumerate(langs):
        own = counted[(counted["lang"] == lang) & (counted["bucket"] >= 0)]
        matrix[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    matrix = np.log(matrix + 0.5)
    matrix -= np.logaddexp.reduce(matrix, axis=0) if langs else 0
    return langs, matrix.astype(np.float32)


def score(docs: DataFrame, langs: list[str], matrix: np.ndarray,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of each whole text.

    ``score`` is the posterior with the log-likelihood taken per n-gram and sharpened, so that it
    stays below 1 for mixed texts of any length. Languages have equal priors.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for batch in batches:
            pred, sure = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sums, n = np.zeros(len(langs)), 0
                for f in features(text):
                    sums += np.take(matrix, f, axis=0).sum(axis=0, dtype=np.float64)
                    n += f.size
                if not langs or not any(c.isalpha() for c in text):
                    pred.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                best = int(sums.argmax())
                odds = np.exp((sums - sums[best]) / n * 20)
                pred.append(langs[best])
                sure.append(float(1 / odds.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(sure, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
