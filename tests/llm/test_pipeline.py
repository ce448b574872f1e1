import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pitchframe.llm import minhash_dedup
from pitchframe.llm.common import documents, labels, materialise
from pitchframe.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_leaks_and_pii import brute_spans
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [documents(spark, SF)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].count() == stages[-2].count() > 0


def test_near_duplicate_stage_equals_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect()]
    _, component = brute(rows, 5, 80)
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == {i for i in component if component[i] == i}


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b, c = a.replace("w59", "x"), " ".join(f"v{i}" for i in range(30))
    rows = [(1, a, "p")] * 3 + [(2, b, "q"), (2, b, "p"), (None, a, "r"), (None, a, "r"), (3, c, "s"), (None, c, "s"),
                                (4, "", "t"), (4, "", "t"), (5, None, "u"), (None, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_n", F.lit(1))
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, a, "p", 1), (3, c, "s", 1), (4, "", "t", 1), (4, "", "t", 1),
                                                       (5, None, "u", 1), (None, None, "v", 1)]))
    # texts of one id that are copies of each other leave one, others stay
    rows = [(7, a, "p"), (7, b, "p"), (7, c, "p"), (None, b, "z")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF)
    assert len({r.text for r in got.collect()}) == got.count() == 2


def test_quality_stage_drops_junk_and_keeps_the_rest(spark, stages):
    marks = {r.doc_id: r.quality for r in labels(spark, SF).collect()}
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    ids = {r.doc_id for r in stages[0].select("doc_id").collect()}
    right = [(i in kept) == (marks[i] == 1) for i in ids if i in marks]
    assert sum(right) >= 0.9 * len(right)


def test_no_personal_data_is_left(stages):
    assert all(not brute_spans(r.text) for r in stages[4].select("text").collect())


def test_decoded_text_is_the_text(stages):
    texts = {r.doc_id: r.text for r in stages[4].select("doc_id", "text").collect()}
    assert {r.doc_id: r.decoded for r in stages[5].select("doc_id", "decoded").collect()} == texts


def test_registered():
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert [f"op{i}_" for i in range(1, 14)] == [next(k for k in QUERIES if k.startswith(f"op{i}_"))[:len(f"op{i}_")]
                                                 for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
