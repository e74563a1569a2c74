"""Registered queries of the package beside their SQL, and the names the driver looks for."""

from __future__ import annotations

import duckdb
import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from quorate.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == ""


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_blanks_of_lines_are_the_same_in_sql(spark, tmp_path):
    lines = ["a\rb\x0cc d", "one two three four five six\r", "one two\x0bthree four five six", "one\ttwo three four five\x0csix", "a b c d e f \xa0 g"]
    rows = [(i, "\n".join(lines[i:] + lines[:i]) + "\r\n", "en", "s", 1) for i in range(len(lines))] + [(9, None, "en", "s", 1), (10, "\r", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(QUERIES["op8_template_tree"](spark, str(tmp_path)), duck, ORACLES["op8_template_tree"]) == ""
