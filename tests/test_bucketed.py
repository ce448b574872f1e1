"""Bucketed domain tables: the same rows without a shuffle under the joins; hot matches stay whole."""

import contextlib
import io
from collections import Counter

import pytest

from pitchframe.plans import passes
from pitchframe.plans.catalog import ANALYTICS, TEST_PARAMS, event_data
from pitchframe.sources import bucketed

ROOT = "/root/testdata/sf0.001"


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def rows(df):
    return Counter(map(repr, df.collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    d = event_data(spark, ROOT)
    root = str(tmp_path_factory.mktemp("buckets") / "a")
    bucketed.write(d, root, 6)
    return bucketed.read(spark, root, d)


def test_enrichment_joins_without_a_shuffle(spark, stored):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(passes.pass_enrichment(stored, TEST_PARAMS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in text and "Exchange" not in text and text.count("Bucketed: true") == 2


@pytest.mark.parametrize("name", ["pass_enrichment", "successful_passes", "team_pass_success", "late_game_passes", "match_goals"])
def test_same_rows_as_unbucketed(spark, stored, name):
    want = ANALYTICS[name](event_data(spark, ROOT), TEST_PARAMS)
    got = ANALYTICS[name](stored, TEST_PARAMS)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_hot_matches_lie_apart_and_stay_whole(spark, tmp_path):
    d = event_data(spark, ROOT)
    bucketed.write(d, str(tmp_path / "hot"), 3, hot_rows=4)
    s = bucketed.read(spark, str(tmp_path / "hot"), d)
    hot = spark.read.parquet(str(tmp_path / "hot" / "hot_matches")).count()
    assert 0 < hot < d.passes.select("MATCH_WYID").distinct().count()
    assert rows(passes.pass_enrichment(s, TEST_PARAMS)) == rows(passes.pass_enrichment(d, TEST_PARAMS))


def test_a_cluster_session_must_name_a_shared_folder():
    from types import SimpleNamespace

    from pitchframe.sources.tables import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_dir(session)
