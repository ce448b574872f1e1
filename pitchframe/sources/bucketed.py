"""Domain tables written once in buckets of the match id, so that the joins on it need no shuffle.

``write`` stores, under one folder, the matches and the passes with the first common row of their event
(the event join does not depend on the scope, so it is done here), both bucketed by the match id into the
same number of buckets and sorted by match and event. ``read`` gives an ``EventData`` whose pass
enrichment joins the two bucket by bucket, for any scope, as often as wanted.

A bucket is read by one task, so a match holding more than ``HOT_ROWS`` passes does not go into one: such
matches' passes lie in a table of their own, joined in the ordinary way (where Spark splits skewed
keys), and the results are united. Nothing is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.passes import first_event_rows
from .tables import EventData

KEY, ORDER = "MATCH_WYID", ("MATCH_WYID", "EVENT_WYID")
HOT_ROWS = 5_000_000


def _save(df: DataFrame, path: str, buckets: int, order: tuple[str, ...]) -> None:
    name = f"pf_{uuid.uuid4().hex}"
    (df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(*order).option("path", path).saveAsTable(name))
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table is external


def _open(spark: SparkSession, path: str, buckets: int, order: tuple[str, ...]) -> DataFrame:
    name = f"pf_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({', '.join(order)}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def pass_events(d: EventData) -> DataFrame:
    """Every pass with the first common row of its event and the event's minute counts."""
    return d.passes.join(first_event_rows(d), "EVENT_WYID", "left")


def write(d: EventData, root: str, buckets: int, hot_rows: int = HOT_ROWS) -> None:
    """Write the bucketed tables of ``d`` under ``root`` (a new folder that all executors reach)."""
    spark = d.matches.sparkSession
    hot = d.passes.groupBy(KEY).count().filter(F.col("count") > hot_rows).select(KEY)
    rows = pass_events(d)
    _save(d.matches, f"{root}/matches", buckets, (KEY,))
    _save(rows.join(hot, KEY, "left_anti"), f"{root}/pass_events", buckets, ORDER)
    rows.join(hot, KEY, "left_semi").write.parquet(f"{root}/hot_pass_events")
    hot.write.parquet(f"{root}/hot_matches")
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{root}/layout")


def read(spark: SparkSession, root: str, others: EventData) -> EventData:
    """``others`` with the matches and the pass enrichment taken from the tables under ``root``."""
    buckets = spark.read.parquet(f"{root}/layout").first()["buckets"]
    matches = _open(spark, f"{root}/matches", buckets, (KEY,))
    cool = _open(spark, f"{root}/pass_events", buckets, ORDER)
    hot, warm = spark.read.parquet(f"{root}/hot_matches"), spark.read.parquet(f"{root}/hot_pass_events")

    def with_passes(scope: DataFrame) -> DataFrame:
        if hot.isEmpty():
            return scope.join(cool, KEY, "left")
        return scope.join(hot, KEY, "left_anti").join(cool, KEY, "left").unionByName(
            scope.join(hot, KEY, "left_semi").join(warm, KEY, "left"))

    return EventData(builders=others.builders | {"matches": lambda: matches}, with_passes=with_passes)
