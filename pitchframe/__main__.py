"""Run named analytics and write each result as parquet.

    spark-submit -m pitchframe ROOT OUT [names ...] [--club 7458] [--seasons 191611 189918] ...

ROOT holds the domain tables as ``<table>.parquet`` (``--testdata`` reads the generated
benchmark tables through the test mapping instead). Each analytic is written to
``OUT/<name>``; with no names every analytic is run.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import constants as K
from .plans.catalog import ANALYTICS, TEST_PARAMS
from .plans.params import Params
from .sources import testdata
from .sources.tables import EventData, write_parquet


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="pitchframe", description=__doc__.splitlines()[0])
    ap.add_argument("root")
    ap.add_argument("out")
    ap.add_argument("names", nargs="*", help="analytics to run (default: all)")
    ap.add_argument("--testdata", action="store_true", help="ROOT holds the generated benchmark tables")
    ap.add_argument("--club", type=int)
    ap.add_argument("--seasons", type=int, nargs="+")
    ap.add_argument("--competitions", type=int, nargs="+")
    ap.add_argument("--date-from")
    ap.add_argument("--as-of")
    ap.add_argument("--match-id", type=int)
    ap.add_argument("--files", nargs="+", default=[], metavar="TABLE=FILE",
                    help="file names of domain tables that differ (several tables may share one file)")
    a = ap.parse_args(argv)
    unknown = [n for n in a.names if n not in ANALYTICS]
    if unknown:
        ap.error(f"unknown analytics {unknown}; choose from {sorted(ANALYTICS)}")

    base = TEST_PARAMS if a.testdata else Params()
    p = Params(club=a.club if a.club is not None else base.club,
               seasons=tuple(a.seasons or base.seasons),
               competitions=tuple(a.competitions or base.competitions),
               date_from=a.date_from or (base.date_from if a.testdata else K.DEFAULT_DATE_FROM),
               as_of=a.as_of or base.as_of, shot_competition=base.shot_competition,
               shot_seasons=base.shot_seasons, match_id=a.match_id)
    spark = SparkSession.builder.appName("pitchframe").getOrCreate()
    files = dict(x.split("=", 1) for x in a.files)
    if wrong := sorted(set(files) - set(EventData.TABLES)):
        ap.error(f"unknown tables {wrong}; choose from {list(EventData.TABLES)}")
    d = testdata.load(spark, a.root) if a.testdata else EventData.from_parquet(spark, a.root, files)
    for name in a.names or sorted(ANALYTICS):
        write_parquet(ANALYTICS[name](d, p), f"{a.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
