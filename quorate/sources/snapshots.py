"""Tables that are replaced or extended at once: data files first, one pointer file last.

A table is a folder with data folders and numbered pointers. A pointer lists the data folders of one
snapshot; the one with the highest number is current. A writer puts its data into a folder of its own and
then renames a finished pointer into place, so a job that dies before leaves the old snapshot, and readers
never need a version number. Two writers that build on the same snapshot want the same number: the second
is refused, and may read again and retry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from quorate.operators.retrieval import query_hash
from quorate.streaming.resume import pending

POINTERS = "_snapshots"


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


def _system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    p = hadoop.fs.Path(path)
    return hadoop, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _latest(spark: SparkSession, base: str) -> tuple[int, list[str]]:
    """(number, data folders) of the current snapshot; number 0 before the first."""
    hadoop, folder, fs = _system(spark, f"{base}/{POINTERS}")
    if not fs.exists(folder):
        return 0, []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith((".", "_")))
    if not names:
        return 0, []
    text = spark.read.text(f"{base}/{POINTERS}/{names[-1]}", wholetext=True).first()[0]
    return int(names[-1]), json.loads(text)


def _point(spark: SparkSession, base: str, number: int, folders: list[str]) -> None:
    hadoop, unfinished, fs = _system(spark, f"{base}/{POINTERS}/.{uuid.uuid4().hex}")
    final = hadoop.fs.Path(f"{base}/{POINTERS}/{number:020d}")
    out = fs.create(unfinished, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    # Renaming onto an existing file is refused.
    if fs.exists(final) or not fs.rename(unfinished, final):
        fs.delete(unfinished, False)
        raise Conflict(f"snapshot {number} of {base} exists already")


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The table's current snapshot, or nothing before the first."""
    _, folders = _latest(spark, base)
    return spark.read.parquet(*[f"{base}/{f}" for f in folders]) if folders else None


def _write(df: DataFrame, base: str, extend: bool, seen: int | None) -> None:
    number, folders = _latest(df.sparkSession, base)
    if seen is not None and seen != number:
        raise Conflict(f"{base} has moved from snapshot {seen} to {number}")
    name = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{base}/{name}")
    _point(df.sparkSession, base, number + 1, [*folders, name] if extend else [name])


def replace(df: DataFrame, base: str) -> None:
    """Make ``df`` the whole table; older snapshots stay readable for those who have begun to."""
    _write(df, base, False, None)


def append_missing(wanted: DataFrame, base: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Do the work for the wanted keys that the table lacks and add its rows; how many keys those were.

    Keys are looked up in the snapshot that is extended, so each is added once: if another writer commits
    in between, this one is refused. The result of the work must carry the keys.
    """
    spark = wanted.sparkSession
    seen, _ = _latest(spark, base)
    todo = pending(wanted, current(spark, base), keys)
    count = todo.count()
    if count:
        _write(work(todo), base, True, seen)
    return count


def store_pools(queries: DataFrame, base: str, search: Callable[[DataFrame], DataFrame]) -> int:
    """Search the queries (query_id, text, ...) whose pools are not stored and keep them under the hash of their text.

    ``search`` gives the pools (query_id, branch, rank, chunk_id, ...) of the queries it gets; queries of one text
    are searched once. Returns the number of new texts.
    """
    keyed = queries.withColumn("query_hash", query_hash(queries["text"]))

    def work(todo: DataFrame) -> DataFrame:
        return search(todo.drop("query_hash")).join(todo.select("query_id", "query_hash"), "query_id").drop("query_id")

    return append_missing(keyed, base, ["query_hash"], work)


def pools_for(queries: DataFrame, base: str) -> DataFrame:
    """The stored pools of queries (query_id, text), under their own numbers."""
    keyed = queries.select("query_id", query_hash(queries["text"]).alias("query_hash"))
    stored = current(queries.sparkSession, base)
    if stored is None:
        raise ValueError(f"no pools are stored at {base}")
    return stored.join(keyed, "query_hash")
