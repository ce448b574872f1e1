"""The command-line entry point writes each chosen analytic as parquet."""

from pitchframe.__main__ import main
from pitchframe.plans.catalog import ANALYTICS, event_data


def test_cli_writes_parquet(spark, tmp_path):
    main(["/root/testdata/sf0.001", str(tmp_path), "standings", "goal_share", "--testdata"])
    assert spark.read.parquet(str(tmp_path / "standings")).count() > 0
    assert spark.read.parquet(str(tmp_path / "goal_share")).count() > 0


def test_domain_tables_may_share_files(spark, tmp_path):
    src = event_data(spark, "/root/testdata/sf0.001")
    root = tmp_path / "db"
    # one common table serves the passes, the log and the shots
    files = {"common": "matchevents_common", "event_log": "matchevents_common", "shot_common": "matchevents_common",
             "secondary": "matchevents_secondarytype", "shot_types": "matchevents_secondarytype",
             "match_teams": "matchdetail_base", "player_stats": "matchdetail_players"}
    for table in src.TABLES:
        name = files.get(table, table)
        if not (root / f"{name}.parquet").exists():
            getattr(src, table).write.parquet(str(root / f"{name}.parquet"))
    assert len(list(root.iterdir())) == 9
    names = sorted(n for n in ANALYTICS if "_with" not in n)[:6]
    main([str(root), str(tmp_path / "out"), *names, "--date-from", "1996-07-19", "--as-of", "2001-12-31", "--club", "1",
          "--files", *[f"{t}={f}" for t, f in files.items()]])
    for n in names:
        spark.read.parquet(str(tmp_path / "out" / n)).count()
