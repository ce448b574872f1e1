"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

*Base.* E-mail, IP, card and phone matches of whole texts (leftmost, not overlapping within a kind;
a match that fails its check is dropped, without retries).

*Disclosure.* Every base match is a protected entity. From all documents, Spark counts in how many
each term stands by an entity (among the ``CONTEXT`` words on either side, however far off they are),
and in how many documents the term stands at all. A term discloses an entity when it stands by it in
at least ``MIN_CONTEXTS`` different texts and the information it gives about the entity, log2 of
p(term | entity) / p(term), reaches ``MIN_DISCLOSURE`` of the entity's own information, log2 of
N / n(entity). Exact copies of a text are one text, so they are no evidence; a passage shared by
otherwise different texts is evidence in each. In documents that
hold the entity, every occurrence of such a term is a span of kind ``term``. ``sanitise`` removes
the terms and generalises the matches to their kind.

Terms are counted in slices of ``SLICE_TERMS`` candidates, and the disclosing (entity, term) pairs are
looked up in slices of as many, so what is broadcast stays bounded. Texts are never shuffled.

Defined results: a null text is empty; repeated rows and null ids get a row each; other columns are
ignored (``sanitise`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import materialise, narrow

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8
MIN_CONTEXTS = 3
MIN_DISCLOSURE = 0.8
SLICE_TERMS = 500_000

Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
_NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def emails(text: str) -> list[Span]:
    """Matches of the e-mail pattern, found from each @: the local part cannot hold one."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all base matches, by start, then kind."""
    out = emails(text) if "@" in text else []
    if text.encode().translate(None, _NOT_DIGITS):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def contexts(text: str, spans: list[Span]) -> list[tuple[str, list[str]]]:
    """(entity, distinct terms around its matches) of each entity; words inside a match are no terms."""
    if not spans:
        return []
    words = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    inside = {w.lower() for a, b, _ in spans for w in TERM.findall(text, a, b)}
    out: dict[str, set[str]] = {}
    for start, end, kind in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        near = words[max(0, before - CONTEXT):before] + words[after:after + CONTEXT]
        out.setdefault(f"{kind}:{text[start:end].lower()}", set()).update(w[2] for w in near)
    return [(entity, sorted(terms - inside)) for entity, terms in out.items()]


def term_spans(text: str, terms: set[str], spans: list[Span]) -> list[Span]:
    """Occurrences of the terms outside the base matches."""
    out, at = [], 0
    ordered = sorted(spans)
    reach = 0
    for m in TERM.finditer(text):
        while at < len(ordered) and ordered[at][0] < m.end():
            reach = max(reach, ordered[at][1])
            at += 1
        if m.start() >= reach and m.group().lower() in terms:
            out.append((m.start(), m.end(), "term"))
    return out


_CONTEXTS = "text_key long, contexts array<struct<entity: string, terms: array<string>>>"
_CONTEXT = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))
_SPANS = ("doc_id {id}, text_key long, n_email long, n_ip long, n_card long, n_phone long, "
          "base_sha256 string, spans string")


def _contexts(docs: DataFrame) -> DataFrame:
    """(text_key, contexts) of the rows that hold an entity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                near = contexts(text, base_spans(text))
                if near:
                    keys.append(key)
                    found.append([dict(zip(("entity", "terms"), c)) for c in near])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, _CONTEXT)],
                                             names=["text_key", "contexts"])

    return docs.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, _CONTEXTS)


def _all_spans(text: str, terms_of: dict[str, list[str]], more: Iterable[str] = ()) -> tuple[list[Span], list[Span]]:
    """Base spans of a text, and those with the terms that disclose one of its entities (``more`` terms too)."""
    base = base_spans(text)
    terms = set(more).union(*[terms_of.get(f"{kind}:{text[a:b].lower()}", ()) for a, b, kind in base])
    if not terms:
        return base, base
    return base, sorted(base + term_spans(text, terms, base), key=lambda s: (s[0], KINDS.index(s[2])))


def _entity_terms(spark: SparkSession, terms: DataFrame | None) -> list[Broadcast]:
    """{entity: terms} in broadcast slices of about ``SLICE_TERMS`` pairs; one, maybe empty, at least."""
    n = max(1, math.ceil(terms.count() / SLICE_TERMS)) if terms is not None else 1
    out = []
    for k in range(n):
        own: dict[str, list[str]] = {}
        if terms is not None:
            for r in terms.filter(F.pmod(F.xxhash64("entity", "term"), F.lit(n)) == k).collect():
                own.setdefault(r["entity"], []).append(r["term"])
        out.append(spark.sparkContext.broadcast(own))
    return out


def _with_terms(docs: DataFrame, text_col: str, slices: list[Broadcast]) -> DataFrame:
    """``docs`` with ``_terms``: what the given slices disclose about each row; written between slices."""
    docs = docs.withColumn("_terms", F.array().cast("array<string>"))
    for own in slices:
        def terms(batches: Iterator[pd.Series], own=own) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([sorted(set().union(*[own.value.get(f"{k}:{t[a:b].lower()}", ()) for a, b, k in base_spans(t)]))
                                 for t in texts], dtype=object)

        found = F.pandas_udf(terms, "array<string>")(F.coalesce(F.col(text_col), F.lit("")))
        docs = materialise(docs.withColumn("_terms", F.array_union("_terms", found)), "pii-terms")
    return docs


def _document_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, n_term): documents that hold each candidate term, one pass per slice of candidates."""
    sc = docs.sparkSession.sparkContext
    slices = math.ceil(candidates.count() / SLICE_TERMS)
    out = None
    for k in range(slices):
        terms = sc.broadcast(frozenset(r["term"] for r in candidates.filter(
            F.pmod(F.xxhash64("term"), F.lit(slices)) == k).collect()))

        def run(batches: Iterator[pa.RecordBatch], terms=terms) -> Iterator[pa.RecordBatch]:
            wanted, n = terms.value, {}
            for batch in batches:
                for t in batch.column(0):
                    for term in wanted.intersection(TERM.findall(t.as_py().lower())):
                        n[term] = n.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                                             names=["term", "n"])

        counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long")
        counted = counted.groupBy("term").agg(F.sum("n").alias("n_term"))
        out = counted if out is None else out.union(counted)
    return out


def disclosing(docs: DataFrame) -> DataFrame | None:
    """(entity, term, disclosure) of terms over the threshold; None where no term is near it."""
    base = materialise(_contexts(docs), "pii-contexts")
    near = base.select("text_key", F.explode("contexts").alias("c")).select("text_key", "c.entity", "c.terms")
    # a row has each pair once; equal texts are added up first and are one piece of evidence
    pairs = (near.select("entity", "text_key", F.explode("terms").alias("term"))
             .groupBy("entity", "term", "text_key").agg(F.count("*").alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_texts"))
             .filter(F.col("n_texts") >= MIN_CONTEXTS).drop("n_texts"))
    pairs = materialise(pairs, "disclosure")
    candidates = pairs.select("term").distinct()
    if candidates.isEmpty():
        return None
    n_docs = docs.count()
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity"))
    counted = materialise(_document_counts(docs, candidates), "terms")

    def log2(x: Column) -> Column:
        return F.log(2.0, x)

    scored = pairs.join(counted, "term").join(entities, "entity").withColumn(
        "disclosure", F.try_divide(
            log2(F.col("n_both") / F.col("n_entity") * n_docs / F.col("n_term")),
            log2(F.lit(float(n_docs)) / F.col("n_entity"))))
    return materialise(scored.filter(F.col("disclosure") >= MIN_DISCLOSURE).select("entity", "term", "disclosure"),
                       "disclosing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    Texts are read twice, for the statistics and for the spans, and never shuffled."""
    docs = narrow(docs, id_col, text_col)
    *others, last = _entity_terms(docs.sparkSession, disclosing(docs))
    rows = _with_terms(docs, "text", others).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"), "_terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_all_spans(t.as_py(), last.value, more)
                     for t, more in zip(batch.column(2), batch.column(3).to_pylist())]
            texts = [joined(base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *[pa.array([sum(x[2] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS[:4]],
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                 pa.array([t if own is base else joined(own) for t, (base, own) in zip(texts, found)], pa.string())],
                names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return rows.mapInArrow(run, _SPANS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def rewrite(text: str, spans: str) -> str:
    """Matches generalised to ``[kind]``, terms removed; of overlapping spans the first is named."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, start, end = item.split(":")
        if int(start) >= at:
            out.append(text[at:int(start)])
            out.append("" if kind == "term" else f"[{kind}]")
        at = max(at, int(end))
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts; other columns and null texts stay as they are.

    Texts are read twice, for the statistics and for rewriting, and never shuffled or joined."""
    narrowed = narrow(docs, id_col, text_col)
    *others, last = _entity_terms(docs.sparkSession, disclosing(narrowed))

    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, more in batches:
            yield pd.Series([None if t is None else rewrite(t, joined(_all_spans(t, last.value, m)[1]))
                             for t, m in zip(texts, more)], dtype=object)

    new = F.pandas_udf(rewritten, "string")(F.col(text_col), F.col("_terms"))
    return _with_terms(docs, text_col, others).withColumn(text_col, new).select(*docs.columns)
