"""Session helpers: a tuned local session, the checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side, in rows, that an operator hints for broadcast after counting it.
BROADCAST_ROWS = 200_000


def local_session(app: str = "quorate", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUORATE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the shared one that the cluster names.

    Only when neither ``spark.checkpoint.dir`` nor a context checkpoint folder is set, and the
    session is local (tests on one machine), is a temporary folder created.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared folder and read it back.

    The lineage ends in reliable files, so a lost executor repeats only later work, and each reader
    prunes columns and pushes filters into the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one job with an owner that drops them: ``with Scratch(spark) as scratch``.

    What outlives the block must be written elsewhere before it ends; nothing may read a table later. Shuffle
    files of a finished job are dropped when the driver collects its garbage; it is asked to after each table.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Like ``materialise``, in the folder of this owner."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition rows for costly per-row work only when there are fewer partitions than slots.

    A table of many files or row groups already has more partitions than that and is left alone.
    Call it on scans and projections of scans, where counting partitions runs nothing.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count proves that the side is small.

    Above the bound the side is returned as it is and the planner shuffles both sides, with
    adaptive skew handling.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def values_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """Small parameter table (plan-time constants) as an inlined local relation."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, int):
            return str(value)
        if isinstance(value, float):
            return f"double('{value!r}')"
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = ", ".join(c.strip() for c in columns.split(","))
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
