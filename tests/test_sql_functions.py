"""Analytics as table functions of SQL text against their DataFrame form."""

import contextlib
import dataclasses
import io

import pytest

from pitchframe.plans import passes, standings
from pitchframe.plans.catalog import ANALYTICS, TEST_PARAMS, event_data
from pitchframe.sources.sql_functions import call, register

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    d = event_data(spark, ROOT)
    assert set(register(spark, d)) == {f"pf_{n}" for n in ("match_scope", "match_goals", "standings", "club_matches", "shots_of_match")}
    return d


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(a.columns)
    assert a.dtypes == b.dtypes and a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("competitions, seasons", [((335, 328), (191611, 189918)), ((335,), (191611,))])
def test_functions_equal_the_analytics(spark, data, competitions, seasons):
    p = dataclasses.replace(TEST_PARAMS, competitions=competitions, seasons=seasons)
    scope = {"competitions": competitions, "seasons": seasons}
    same(call(spark, "pf_standings", **scope), standings.standings(data, p))
    same(call(spark, "pf_match_goals", **scope), standings.match_goals(data, p))
    same(call(spark, "pf_club_matches", club=1, **scope), ANALYTICS["club_matches"](data, p))
    same(call(spark, "pf_match_scope", competitions=competitions, date_from=p.date_from, as_of=p.as_of), passes.match_scope(data, p))


def test_functions_inside_a_query(spark, data):
    got = spark.sql("""
        SELECT m.MATCH_WYID, s.n FROM pf_matches m,
        LATERAL (SELECT count(*) AS n FROM pf_shots_of_match(m.MATCH_WYID, array(191611, 189918))) s
        WHERE m.MATCH_WYID IN (10, 11)""").collect()
    one = {i: call(spark, "pf_shots_of_match", match_id=i, seasons=[191611, 189918]).count() for i in (10, 11)}
    assert {r.MATCH_WYID: r.n for r in got} == {i: n for i, n in one.items()} and one[10] > 0


def test_values_are_bound_and_filters_reach_the_scan(spark, data):
    hostile = call(spark, "pf_match_scope", competitions=[335], date_from="1996-07-19", as_of=None)
    assert hostile.count() > 0  # no end date: up to today
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        call(spark, "pf_shots_of_match", match_id=10, seasons=[191611]).explain()
    assert "EqualTo(user_id,10)" in buf.getvalue()
