"""Readers for the event-data tables and the container the analytics take.

The original pulls each table from a relational database by SQL text; here a table
is a DataFrame read from parquet (or any JDBC source the user configures), so that
column pruning and filter pushdown reach the scan.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session; only a local
    session that names none gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pitchframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def read_parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>.parquet`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """A database table read in parallel slices of ``partition_column`` when given.

    Credentials come from ``properties`` supplied by the caller; nothing is hard-wired."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions))
    return reader.load()


def sql_query(spark: SparkSession, text: str, tables: dict[str, DataFrame],
              args: dict | None = None) -> DataFrame:
    """SQL text over DataFrames: ``{name}`` placeholders refer to ``tables`` (no global
    views are registered) and ``:param`` markers are bound from ``args`` as literals,
    never spliced into the text. Catalyst plans it exactly like the DataFrame form."""
    return spark.sql(text, args=args or {}, **tables)


def in_list_params(prefix: str, values) -> tuple[str, dict]:
    """``(:p0, :p1, ...)`` text and its bindings, for an IN list of any length."""
    names = [f"{prefix}{i}" for i in range(len(values))]
    return "(" + ", ".join(":" + n for n in names) + ")", dict(zip(names, values))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


@dataclass
class EventData:
    """The domain tables, each a DataFrame (built lazily on first use).

    matches        MATCH_WYID, SEASON_WYID, COMPETITION_WYID, DATE, MATCHLABEL
    passes         MATCH_WYID, EVENT_WYID, PLAYER_WYID, RECIPIENT_WYID, LENGTH,
                   ENDLOCATIONX, ENDLOCATIONY, ACCURATE
    common         EVENT_WYID, MATCH_WYID, SEASON_WYID, TEAM_WYID, PRIMARYTYPE,
                   LOCATIONX, LOCATIONY, MINUTE          (events of the pass data)
    secondary      EVENT_WYID, MATCH_WYID, PRIMARYTYPE, SECONDARYTYPE1..k  (pass tags)
    event_log      EVENT_WYID, MATCH_WYID, SEASON_WYID, TEAM_WYID, PRIMARYTYPE
                   (the ordered log used for pass -> shot sequences)
    shots          EVENT_WYID, MATCH_WYID, PLAYER_WYID, TEAM_WYID, SHOTISGOAL,
                   SHOTBODYPART, SHOTONTARGET, SHOTXG
    shot_types     EVENT_WYID, MATCH_WYID, PRIMARYTYPE   (secondary types of shots)
    shot_common    common rows of shot events (coordinates, minute)
    match_teams    MATCH_WYID, TEAM_WYID, SCORE ("a-b" text)
    player_stats   MATCH_WYID, PLAYER_WYID, TEAM_WYID, PLAYERASSISTS
    players        PLAYER_WYID, ROLENAME, SHORTNAME
    teams          TEAM_WYID, TEAMNAME
    """

    builders: dict[str, Callable[[], DataFrame]]
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    TABLES = ("matches", "passes", "common", "secondary", "event_log", "shots", "shot_types",
              "shot_common", "match_teams", "player_stats", "players", "teams")

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, names: dict[str, str] | None = None) -> "EventData":
        """Domain tables stored as ``<root>/<file>.parquet``; ``names`` maps a domain table
        to its file name where they differ (by default the file is named like the table)."""
        names = names or {}
        return cls(builders={t: (lambda t=t: read_parquet(spark, root, names.get(t, t))) for t in cls.TABLES})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, tables: dict[str, str],
                  properties: dict | None = None, partitions: dict[str, dict] | None = None) -> "EventData":
        """Domain tables read from a database: ``tables`` maps a domain table to a database
        table (or a parenthesised query; several domain tables may name the same one);
        credentials come from ``properties``. ``partitions`` gives a table's ``partition_column``,
        ``lower_bound``, ``upper_bound`` and ``num_partitions``, so that it is read in parallel."""
        partitions = partitions or {}
        return cls(builders={t: (lambda t=t, src=src: read_jdbc(spark, url, src, properties, **partitions.get(t, {})))
                             for t, src in tables.items()})

    #: How bucketed tables join a match scope with its enriched passes (``sources/bucketed``).
    with_passes: Callable[[DataFrame], DataFrame] | None = None
    _derived: dict[Any, DataFrame] = field(default_factory=dict)
    _paths: list[str] = field(default_factory=list)
    _store: bool = False

    def derived(self, key: Any, build: Callable[[], DataFrame]) -> DataFrame:
        """A table several analytics share: the stored one if there is one, else its lazy plan.

        Inside ``storing`` it is written as Parquet to the shared folder and read back from
        there, so that readers still prune columns and push filters."""
        if key in self._derived:
            return self._derived[key]
        df = build()
        if not self._store:
            return df
        path = f"{shared_dir(df.sparkSession)}/derived-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._paths.append(path)
        self._derived[key] = df.sparkSession.read.schema(df.schema).parquet(path)
        return self._derived[key]

    @contextlib.contextmanager
    def storing(self):
        """Derived tables first used in this block are stored."""
        self._store = True
        try:
            yield self
        finally:
            self._store = False

    def release(self) -> None:
        """Delete the stored tables; later uses read the domain tables anew."""
        spark = next(iter(self._derived.values())).sparkSession if self._derived else None
        for path in self._paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        self._paths.clear()
        self._derived.clear()
        self._cache.clear()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("builders", "derived", "release", "storing", "TABLES"):
            raise AttributeError(name)
        if name not in self._cache:
            if name not in self.builders:
                raise AttributeError(name)
            self._cache[name] = self.builders[name]()
        return self._cache[name]
