"""Every registered analytic against its DuckDB SQL, result properties, and plan shape."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from pitchframe.plans.catalog import ANALYTICS, TEST_PARAMS, event_data
from pitchframe.sources.tables import EventData
from tests.oracle_check import compare

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_every_query_has_oracle_sql():
    assert set(ANALYTICS) <= set(E.queries()) and set(ANALYTICS) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["TEAM_WYID", "TEAMNAME", "total", "success", "success_rate"]
    assert df.count() > 0


@pytest.mark.parametrize("sf", [SMALL, MID])
def test_all_queries_match_duckdb(spark, sf):
    res = compare(spark, sf)
    bad = {k: v for k, v in res.items()
           if "error" in v or not v.get("values_match") or v["rows"][0] != v["rows"][1]}
    assert not bad, bad
    assert not [k for k, v in res.items() if not v["rows"][0]]  # two empty results would compare nothing


def _rows(spark, name, sf=MID):
    return E.queries()[name](spark, sf).collect()


def test_success_never_exceeds_total(spark):
    for r in _rows(spark, "team_pass_success"):
        assert 0 <= r.success <= r.total
    for r in _rows(spark, "last_third_summary"):
        assert 0 <= r.success <= r.total


def test_shares_sum_to_100(spark):
    for name, col in (("goal_share", "pct"), ("shot_precision", "pct")):
        assert abs(sum(getattr(r, col) for r in _rows(spark, name)) - 100) < 1e-3
    by_season = {}
    for r in _rows(spark, "late_game_share"):
        by_season[r.SEASON_WYID] = by_season.get(r.SEASON_WYID, 0) + r.share_pct
    assert all(abs(v - 100) < 1e-3 for v in by_season.values())
    assert abs(sum(r.share for r in _rows(spark, "assist_distribution")) - 1) < 1e-5  # 6-place rounding


def test_rank_is_a_permutation_per_season(spark):
    ranks = {}
    for r in _rows(spark, "standings"):
        ranks.setdefault(r.SEASON_WYID, []).append(r.rank)
    for v in ranks.values():
        assert sorted(v) == list(range(1, len(v) + 1))


def test_bins_partition_located_shots(spark):
    total = sum(r.shots for r in _rows(spark, "conversion_by_distance"))
    located = E.queries()["match_shots"](spark, MID).count()
    assert total == located


def test_no_python_in_any_plan(spark):
    for name in ANALYTICS:
        plan = _plan(E.queries()[name](spark, SMALL))
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"):
            assert node not in plan, name


def test_top_k_is_take_ordered(spark):
    for name in ("bottom3_pass_success", "top3_pass_success", "assist_length_top3", "top_scorers_xg"):
        assert "TakeOrderedAndProject" in _plan(E.queries()[name](spark, SMALL)), name


def test_filters_reach_the_scan(spark):
    plan = _plan(E.queries()["match_scope"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan


def test_sequence_operator_windows_by_range(spark):
    plan = _plan(E.queries()["passes_leading_to_shot"](spark, SMALL))
    assert "hashpartitioning(_range" in plan and plan.count("rangepartitioning(MATCH_WYID") == 1


def test_building_any_analytic_starts_no_job(spark):
    sc, d = spark.sparkContext, event_data(spark, SMALL)
    assert all(getattr(d, t).columns for t in d.TABLES)  # reading a schema is a job of the reader's
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for name in ("passes_leading_to_shot", "assist_vs_other_length", "standings", "late_game_passes"):
            sc.setJobGroup(f"build-{name}", name)
            ANALYTICS[name](d, TEST_PARAMS)
            assert not sc.statusTracker().getJobIdsForGroup(f"build-{name}"), name
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_first_rows_take_no_window(spark):
    for name in ("pass_enrichment", "shots_by_season", "shot_coordinates"):
        assert "Window" not in _plan(E.queries()[name](spark, SMALL)), name


def test_enrichment_reads_each_table_once(spark):
    for name in ("pass_enrichment", "valid_passes", "valid_passes_club"):
        assert _plan(E.queries()[name](spark, SMALL)).count("FileScan") == 3, name


def test_median_reads_the_marked_passes_once(spark):
    df = E.queries()["assist_vs_other_length"](spark, SMALL)
    assert df.count() == 2
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 4  # matches, passes, common, tags


def test_unread_success_flags_are_left_out(spark):
    for name in ("assist_vs_other_length_club", "assist_length_gap", "assist_rate_by_line", "assist_distribution"):
        plan = _plan(E.queries()[name](spark, SMALL))
        assert "_passer" not in plan and plan.count("FileScan") <= 6, name  # the matches twice, the players


def test_building_a_query_reads_no_stored_table(spark):
    for name in ("team_pass_success", "assist_length_gap", "match_goals"):
        assert "Scan ExistingRDD" not in _plan(E.queries()[name](spark, SMALL)), name


ORDERED = ("team_pass_success", "standings", "assist_length_by_team", "club_matches", "match_list_with_goals",
           "conversion_by_angle", "last_third_all_teams", "all_scorers_xg")


def test_results_come_in_the_original_order(spark):
    rows = {n: E.queries()[n](spark, SMALL).collect() for n in ORDERED}

    def key(*values):
        return tuple((v is None, v if v is not None else 0) for v in values)

    keys = {
        "team_pass_success": lambda r: key(r.success_rate, r.TEAM_WYID),
        "standings": lambda r: key(r.SEASON_WYID, r["rank"]),
        "assist_length_by_team": lambda r: key(r.mean_length, r.TEAM_WYID),
        "club_matches": lambda r: ((r.MATCHLABEL is None, r.MATCHLABEL or ""), r.MATCH_WYID),
        "match_list_with_goals": lambda r: (r.label_with_season, r.MATCH_WYID),
        "conversion_by_angle": lambda r: key(r.bin_idx),
        "last_third_all_teams": lambda r: key(-r.success_rate if r.success_rate is not None else None, r.TEAM_WYID),
        "all_scorers_xg": lambda r: key(-r.goals, r.PLAYER_WYID),
    }
    for n, found in rows.items():
        assert len(found) > 1 and found == sorted(found, key=keys[n]), n


def test_filters_reach_parquet_domain_tables(spark, tmp_path):
    src = event_data(spark, SMALL)
    for t in src.TABLES:
        getattr(src, t).limit(2000).write.parquet(str(tmp_path / f"{t}.parquet"))
    d = EventData.from_parquet(spark, str(tmp_path))

    def pushed(name):
        return " ".join(line for line in _plan(ANALYTICS[name](d, TEST_PARAMS)).splitlines() if "PushedFilters" in line)

    assert "In(SEASON_WYID" in pushed("passes_leading_to_shot")
    for name in ("match_goals", "shots_by_season"):
        assert "In(SEASON_WYID" in pushed(name) and "COMPETITION_WYID" in pushed(name), name
    assert "EqualTo(PRIMARYTYPE,shot)" in pushed("conversion_by_minute")
    assert "In(SEASON_WYID" in pushed("match_list_with_goals")
    assert "PLAYER_WYID,0" in pushed("valid_passes")


def _unpartitioned_windows_read_aggregates(plan: str) -> bool:
    """Every window without a partition key must read an aggregate through its
    single-partition exchange, never row-level data."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" not in line or "windowspecdefinition(" not in line:
            continue
        spec = line.split("windowspecdefinition(", 1)[1]
        first = spec.split(",", 1)[0]
        if not (first.startswith("specifiedwindowframe") or " ASC " in first + " " or " DESC " in first + " "):
            continue  # partitioned window
        depth = len(line) - len(line.lstrip(" :|+-"))
        below = []
        for nxt in lines[i + 1:]:
            if len(nxt) - len(nxt.lstrip(" :|+-")) <= depth:
                break
            below.append(nxt)
        seen_exchange = False
        for op in below:
            if "Exchange SinglePartition" in op:
                seen_exchange = True
            elif seen_exchange and ("Aggregate" in op):
                break
            elif seen_exchange and ("Scan" in op or "Exchange" in op):
                return False
        else:
            return False
    return True


def test_no_unpartitioned_window_over_rows(spark):
    for name, q in ((n, E.queries()[n]) for n in ANALYTICS):
        assert _unpartitioned_windows_read_aggregates(_plan(q(spark, SMALL))), name
