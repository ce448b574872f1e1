"""Live version of the per-team accuracy counter (``accuracy_flag_success``).

The original re-runs its pass summaries on demand. When enriched pass rows (the
``pass_enrichment`` table) arrive continuously, for example one parquet file per
finished match, the counter is kept up to date by Structured Streaming: the
aggregation state lives in the checkpoint of the query, so a restarted or failed
driver resumes where it stopped.

Only analytics that are additive over new rows can be kept live this way. The success
flag of the other pass analytics depends on the passer set of the whole scope (a late
pass can make an earlier one successful), so they stay batch computations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.semantics import count_true, in_set, pct
from ..plans.params import Params
from ..sources.tables import shared_dir


def read_pass_stream(spark: SparkSession, path: str, schema: StructType,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Enriched pass rows appended as parquet files under ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _league(rows: DataFrame, p: Params) -> DataFrame:
    return rows.filter(in_set("SEASON_WYID", p.seasons) & (F.col("PLAYER_WYID") != 0)
                       & (F.col("RECIPIENT_WYID") != 0) & (F.col("PRIMARYTYPE") == "pass"))


def live_team_accuracy(rows: DataFrame, p: Params) -> DataFrame:
    """Running per-team passes, accurate passes and rate (the batch ``accuracy_flag_success``)."""
    return (_league(rows, p).groupBy("TEAM_WYID")
            .agg(F.count(F.lit(1)).alias("total"), count_true(F.col("ACCURATE") == 1).alias("success"))
            .withColumn("success_rate", pct(F.col("success"), F.col("total"))))


def start(agg: DataFrame, name: str, checkpoint: str | None = None, sink: str = "memory",
          path: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Run a live counter. ``checkpoint`` defaults to ``<spark.checkpoint.dir>/<name>``;
    ``sink="memory"`` exposes the table as ``name`` for inspection; any other sink format writes
    the full current table of each trigger to a folder of its own, ``<path>/version=<batch>``,
    so that readers of an earlier version are never disturbed."""
    if checkpoint is None:
        checkpoint = f"{shared_dir(agg.sparkSession)}/{name}"
    w = agg.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    if sink == "memory":
        return w.outputMode("complete").format("memory").start()

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").format(sink).save(f"{path.rstrip('/')}/version={epoch}")

    return w.outputMode("complete").foreachBatch(write).start()
