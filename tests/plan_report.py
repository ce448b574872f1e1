"""Operator trees of the central builds under scale-like settings: automatic broadcast
off (as when every input is large) and shared tables not materialized, so the whole
plan is visible.

    python tests/plan_report.py [name ...]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    out = []
    for line in buf.getvalue().splitlines():
        m = re.match(r"^([ :|+-]*)(\*\(\d+\) )?([A-Za-z]+(?:\([a-z=]+\))?)(.*)$", line)
        if not m or m.group(3) in ("Physical", "AdaptiveSparkPlan"):
            continue
        name, rest = m.group(3), m.group(4)
        detail = ""
        if name in ("Exchange",):
            detail = " " + rest.strip().split(",")[0]
        elif name in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"):
            detail = " " + " ".join(w for w in rest.split(",") if w.strip() in (
                "LeftOuter", "Inner", "LeftSemi", "LeftAnti", "BuildRight", "BuildLeft"))
        elif name == "FileScan":
            detail = " " + rest.split("[", 1)[0].strip()
        out.append(f"{m.group(1)}{name}{detail}")
    return "\n".join(out)


def main(names):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from pitchframe.sources import testdata

    from pitchframe.operators.quantile import exact_median
    from pitchframe.plans import assists, passes, standings
    from pitchframe.plans.catalog import TEST_PARAMS as P

    d = testdata.load(spark, "/root/testdata/sf0.001")
    from pitchframe.operators.sequence import next_event

    builds = {
        "scoped_passes": lambda: passes.scoped_passes(d, P),
        "next_event": lambda: next_event(d.event_log.select("MATCH_WYID", "EVENT_WYID", "TEAM_WYID", "PRIMARYTYPE"),
                                         ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"]),
        "exact_median": lambda: exact_median(d.passes, ["ACCURATE"], "LENGTH", "m"),
        "match_goals": lambda: standings.match_goals(d, P),
        "passes_leading_to_shot": lambda: passes.passes_leading_to_shot(d, P),
        "assist_vs_other_length": lambda: assists.assist_vs_other_length(d, P),
    }
    for name in names or builds:
        print(f"### {name}\n\n```\n{tree(builds[name]())}\n```\n")


if __name__ == "__main__":
    main(sys.argv[1:])
