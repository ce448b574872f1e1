"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Per document (a null text counts as empty) the projection measures words, symbols, repeated
lines, repeated eight-word windows, upper-case letters and stop words, forms ratios of them
and compares each ratio with its row of ``RULES``. There is no shuffle and no Python; a very
long text costs O(n log n) in its own row.

Defined results: a null or empty text has zero words and fails; repeated rows each get their
own row; a null id is passed through; other columns of the input are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import narrow

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Very frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his are this at from or an "
    "der die das und ist von mit den für ein eine im zu des nicht sich auf dem "
    "le la les et est de du des en un une que pour dans qui avec sur par "
    "el los las y es del se por con una para no lo su al como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when ``at_least <= ratio <= at_most`` (null bound: open)."""

    ratio: str
    at_least: float | None
    at_most: float | None


#: The threshold table.
RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.30),
    Rule("stop_word_share", 0.01, None),
    Rule("duplicate_line_share", None, 0.50),
    Rule("upper_case_share", None, 0.50),
    Rule("repeated_word_share", None, 0.30),
)


def _windows(words: str) -> Column:
    """Hashes of all eight-word windows, by doubling: 1, 2, 4, 8 words."""
    n = F.size(words)
    grams = F.transform(words, lambda w: F.xxhash64(w))
    width = 1
    while width < WINDOW:
        keep = F.greatest(n - (2 * width - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, 1, keep), F.slice(grams, F.lit(1 + width), keep),
                           lambda a, b: F.xxhash64(a, b))
        width *= 2
    return grams


def _neighbours(col: str | Column, size: Column, f) -> Column:
    return F.zip_with(F.slice(col, F.lit(1), size - 1), F.slice(col, F.lit(2), size - 1), f)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts and the ratios the rules read."""
    d = narrow(docs, id_col, text_col).withColumn(
        "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn(
        "lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
        F.when(F.size("words") > WINDOW, _windows("words")).alias("windows"))
    # only a text with a repeated window pays for finding the places
    d = d.withColumn("places", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("starts", F.array_sort(F.array_distinct(F.flatten(_neighbours(
        "places", F.size("places"),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
            F.array().cast("array<int>")))))))
    covered = F.aggregate(
        _neighbours("starts", F.size("starts"), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(WINDOW), lambda total, x: total + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("starts").isNotNull(), covered)
                     .otherwise(F.lit(0)).cast("long"))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_stop", "n_words").alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("duplicate_line_share"),
        share("n_upper", "word_chars").alias("upper_case_share"),
        share("n_repeat_words", "n_words").alias("repeated_word_share"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table compiled into one boolean expression."""
    passed = F.lit(True)
    for r in rules:
        if r.at_least is not None:
            passed = passed & (F.col(r.ratio) >= F.lit(float(r.at_least)))
        if r.at_most is not None:
            passed = passed & (F.col(r.ratio) <= F.lit(float(r.at_most)))
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures plus ``base_failed`` and ``kept`` (false if the base failed, else the table's verdict)."""
    base_failed = ((F.col("n_words") < MIN_WORDS)
                   | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return (measures(docs, id_col, text_col)
            .withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))
