"""Tables with a pointer that is written last."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quorate.sources import snapshots as sn


def keys(df):
    return sorted(r.k for r in df.collect())


def test_replace_and_append(spark, tmp_path):
    base = str(tmp_path / "t")
    assert sn.current(spark, base) is None
    rows = spark.range(5).withColumnRenamed("id", "k")
    sn.replace(rows, base)
    first = sn.current(spark, base)
    assert keys(first) == [0, 1, 2, 3, 4]
    assert sn.append_missing(spark.range(8).withColumnRenamed("id", "k"), base, ["k"], lambda d: d) == 3
    assert sn.append_missing(spark.range(8).withColumnRenamed("id", "k"), base, ["k"], lambda d: d) == 0
    assert keys(sn.current(spark, base)) == list(range(8))
    sn.replace(rows.where("k = 2"), base)
    assert keys(sn.current(spark, base)) == [2] and keys(first) == [0, 1, 2, 3, 4]


def test_a_crashed_append_leaves_the_old_snapshot(spark, tmp_path):
    base = str(tmp_path / "t")
    sn.replace(spark.range(3).withColumnRenamed("id", "k"), base)

    def work(todo):
        return todo.select(F.when(F.col("k") == 6, F.raise_error(F.lit("lost"))).otherwise(F.col("k")).cast("bigint").alias("k"))

    with pytest.raises(Exception):
        sn.append_missing(spark.range(7).withColumnRenamed("id", "k"), base, ["k"], work)
    assert keys(sn.current(spark, base)) == [0, 1, 2]
    assert sn.append_missing(spark.range(7).withColumnRenamed("id", "k"), base, ["k"], lambda d: d) == 4


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    base = str(tmp_path / "t")
    sn.replace(spark.range(3).withColumnRenamed("id", "k"), base)

    def work(todo):
        # Another writer commits while this one works.
        sn.append_missing(spark.range(4).withColumnRenamed("id", "k"), base, ["k"], lambda d: d)
        return todo

    with pytest.raises(sn.Conflict):
        sn.append_missing(spark.range(5).withColumnRenamed("id", "k"), base, ["k"], work)
    assert keys(sn.current(spark, base)) == [0, 1, 2, 3]
    with pytest.raises(sn.Conflict):
        sn._point(spark, base, 2, [])
    assert keys(sn.current(spark, base)) == [0, 1, 2, 3]


def test_pools_are_searched_once_per_text(spark, tmp_path):
    base, asked = str(tmp_path / "p"), []

    def search(todo):
        asked.append(sorted(r.text for r in todo.collect()))
        return todo.select("query_id", F.lit("dense").alias("branch"), F.lit(1).alias("rank"), F.concat(F.lit("c"), "text").alias("chunk_id"))

    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "query_id int, text string")
    with pytest.raises(ValueError):
        sn.pools_for(queries, base)
    assert sn.store_pools(queries.where("query_id < 4"), base, search) == 2
    assert sn.store_pools(queries, base, search) == 1 and sn.store_pools(queries, base, search) == 0
    assert asked == [["a", "b"], ["c"]]
    assert sorted((r.query_id, r.chunk_id) for r in sn.pools_for(queries, base).collect()) == [(1, "ca"), (2, "cb"), (3, "ca"), (4, "cc")]
