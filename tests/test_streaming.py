"""The live counters over files arriving in three chunks equal the batch analytic."""

import tempfile

from pyspark.sql import functions as F

from pitchframe.plans import passes
from pitchframe.plans.catalog import TEST_PARAMS, event_data
from pitchframe.streaming import live


def test_live_team_accuracy_equals_batch(spark):
    d = event_data(spark, "/root/testdata/sf0.001")
    rows = passes.pass_enrichment(d, TEST_PARAMS)
    src = tempfile.mkdtemp(prefix="pf-stream-src-")
    for i in range(3):
        rows.filter(F.col("MATCH_WYID") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    stream = live.read_pass_stream(spark, src, rows.schema, max_files_per_trigger=1)
    q = live.start(live.live_team_accuracy(stream, TEST_PARAMS), "live_team_accuracy_test",
                   checkpoint=tempfile.mkdtemp(prefix="pf-stream-ck-"), available_now=True)
    q.awaitTermination(120)
    got = {r.TEAM_WYID: (r.total, r.success) for r in spark.table("live_team_accuracy_test").collect()}
    want = {r.TEAM_WYID: (r.total, r.success)
            for r in passes.accuracy_flag_success(d, TEST_PARAMS).collect()}
    assert got == want and len(got) > 0
