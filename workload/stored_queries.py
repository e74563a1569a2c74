"""Queries that write tables to the shared folder and read them back, and small decision rules over tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorate.functions.text import strip
from quorate.operators import comparison as cp
from quorate.operators import evaluation as ev
from quorate.operators import panel as pn
from quorate.operators import prompts as pr
from quorate.operators import retrieval as rt
from quorate.session import shared_folder
from quorate.sources import snapshots as sn
from quorate.sources import tables as tb
from quorate.streaming import resume
from workload import fixtures as fx
from workload.ctes import r6, with_ctes
from workload.registry import query
from workload.retrieval_queries import pools_of
from workload.source_queries import served_documents


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query("judged_labels", with_ctes("""
SELECT item_id, agent_id, CAST(CASE WHEN NOT valid_json OR item_id % 7 = 0 THEN 0 ELSE z END AS INTEGER) AS label FROM fx_panel"""))
def judged_labels(spark, sf_dir):
    """Labels of answers; items whose number is divisible by seven stand for blank responses."""
    response = F.when(F.col("item_id") % 7 == 0, F.lit("  ")).otherwise(F.lit("texto"))
    label = pn.judged_label(F.col("z"), F.col("valid_json"), response)
    return fx.panel(spark, sf_dir).select("item_id", "agent_id", label.alias("label"))


@query("budget_split", with_ctes("""
SELECT o_orderkey AS item_id, CAST(greatest(ceil(t * (d / CAST(d + l AS DOUBLE))), 1) AS INTEGER) AS k_dense,
       CAST(greatest(t - greatest(ceil(t * (d / CAST(d + l AS DOUBLE))), 1), 1) AS INTEGER) AS k_lexical
FROM (SELECT o_orderkey, o_custkey % 20 + 1 AS t, o_orderkey % 30 + 1 AS d, o_orderkey % 7 + 1 AS l FROM orders)"""))
def budget_split(spark, sf_dir):
    """A budget of chunks per order, shared by two branches whose depths differ by order."""
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 20 + 1).alias("t"),
        (F.col("o_orderkey") % 30 + 1).alias("d"), (F.col("o_orderkey") % 7 + 1).alias("l"),
    )
    dense, lexical = rt.split_budget(F.col("t"), F.col("d"), F.col("l"))
    return orders.select("item_id", dense.alias("k_dense"), lexical.alias("k_lexical"))


@query("rung_verdicts", r6("""
SELECT pos, rung, point, ci_lo, previous, CASE WHEN previous IS NULL THEN 'base' WHEN ci_lo > previous THEN 'confirmed' ELSE 'not confirmed' END AS verdict
FROM (SELECT *, lag(point) OVER (ORDER BY pos) AS previous FROM (
  SELECT pos, 'R' || pos AS rung, p AS point, p - 1.96 * sqrt(p * (1 - p) / n) AS ci_lo
  FROM (SELECT l_linenumber AS pos, avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS p, count(*) AS n FROM lineitem GROUP BY 1)))""",
  "point", "ci_lo", "previous"))
def rung_verdicts(spark, sf_dir):
    """Line numbers as rungs, their share of status F with a normal lower bound."""
    p = F.avg((F.col("l_linestatus") == "F").cast("int"))
    rungs = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("pos")).agg(p.alias("point"), F.count("*").alias("n"))
    lower = F.col("point") - 1.96 * F.sqrt(F.col("point") * (1 - F.col("point")) / F.col("n"))
    return cp.rung_verdicts(rungs.select("pos", F.concat(F.lit("R"), "pos").alias("rung"), "point", lower.alias("ci_lo")))


@query("served_context", with_ctes("""
SELECT doc_id // 10 AS item_id, 'c' || doc_id AS chunk_id, text FROM documents WHERE doc_id % 10 < 4 AND doc_id // 10 % 5 <> 0 AND doc_id % 7 <> 0"""))
def served_context(spark, sf_dir):
    """Texts of served chunks; every fifth item has nothing served and every seventh chunk is not in the index."""
    served, chunks, _ = served_documents(spark, sf_dir)
    return ev.served_context(served, chunks).select("item_id", "chunk_id", "text")


@query("numbered_references", with_ctes("""
SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'P' THEN 'sem referências'
  ELSE 'Referência 1:' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'Referência 2:' || chr(10) || o_orderstatus END AS text FROM orders"""))
def numbered_references(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    texts = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array(strip(F.col("o_orderpriority")), "o_orderstatus"))
    return orders.select(F.col("o_orderkey").alias("item_id"), pr.numbered_list(texts, "Referência", "sem referências").alias("text"))


@query("appended_work", with_ctes("SELECT sha256(text) AS query_hash, count(*) AS n, CAST(1 AS BIGINT) AS stored FROM conversations GROUP BY text"))
def appended_work(spark, sf_dir):
    """Work stored in two instalments, the second over everything: each key is stored once."""
    turns = fx.table(spark, sf_dir, "conversations").select(rt.query_hash(F.col("text")).alias("query_hash"), "turn")
    path = folder(spark)
    for part in (turns.where("turn % 2 = 0"), turns, turns):
        resume.append_pending(part.select("query_hash"), path, ["query_hash"], lambda todo: todo)
    stored = spark.read.parquet(path).groupBy("query_hash").agg(F.count("*").alias("stored"))
    return turns.groupBy("query_hash").agg(F.count("*").alias("n")).join(stored, "query_hash")


@query("table_versions", with_ctes("""
SELECT o_orderkey AS item_id, o_totalprice + 1 AS price FROM orders"""))
def table_versions(spark, sf_dir):
    """A table replaced by a new version; readers get the last one."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("price"))
    base = folder(spark)
    tb.write_version(orders, base, "1")
    last = tb.write_version(orders.withColumn("price", F.col("price") + 1), base, "2")
    return tb.read_table(spark, last, ["item_id", "price"])


@query("decision_partitions", r6("""
SELECT run, baseline, c_min, count(*) AS n, avg(eta) AS eta FROM (
  SELECT 'r1' AS run, 'minimal' AS baseline, c_min, eta FROM fx_mean_decisions) GROUP BY 1, 2, 3""", "eta"))
def decision_partitions(spark, sf_dir):
    """Decisions stored by run, baseline and constraint; the constraints are found from the partitions."""
    from workload.metric_queries import mean_decisions

    path = folder(spark)
    decided = mean_decisions(spark, sf_dir).select("item_id", "c_min", "eta")
    tb.write_decisions(decided.withColumns({"run": F.lit("r1"), "baseline": F.lit("minimal")}), path)
    stored = spark.read.parquet(path)
    wanted = stored.join(F.broadcast(tb.available_constraints(stored)), "c_min")
    return wanted.groupBy("run", "baseline", "c_min").agg(F.count("*").alias("n"), F.avg("eta").alias("eta"))


@query("agent_responses", with_ctes("SELECT item_id, CAST(agent_id AS INTEGER) AS agent_id, conf, z FROM fx_panel"))
def agent_responses(spark, sf_dir):
    """One folder of responses per agent, read as one long table."""
    path = folder(spark)
    fx.panel(spark, sf_dir).select("item_id", "agent_id", "conf", "z").write.partitionBy("agent_id").parquet(path)
    return tb.read_agent_responses(spark, path).select("item_id", F.col("agent_id").cast("int").alias("agent_id"), "conf", "z")


@query("item_export", with_ctes("""
SELECT CAST(agent_chosen AS VARCHAR) AS agent_id, CAST(c_min AS VARCHAR) AS c_min, CAST(item_id AS VARCHAR) AS item_id, CAST(z_winner AS VARCHAR) AS z
FROM fx_mean_decisions"""))
def item_export(spark, sf_dir):
    """The item-level export, read back from its CSV files."""
    from workload.metric_queries import mean_decisions

    path = folder(spark)
    rows = mean_decisions(spark, sf_dir).select(F.col("agent_chosen").alias("agent_id"), "c_min", "fold_k", "item_id", F.col("z_winner").alias("z"))
    tb.export_items_csv(rows, path)
    return spark.read.option("header", True).csv(path).select("agent_id", "c_min", "item_id", "z")

@query("stored_pools", r6("""
SELECT sha256(CAST(query_id AS VARCHAR)) AS query_hash, query_id, branch, rank, chunk_id, source_doc, score FROM fx_pools""", "score"))
def stored_pools(spark, sf_dir):
    """Pools of all questions stored in two instalments under the hash of their text, and read back by number."""
    asked = fx.vector_queries(spark, sf_dir).withColumn("text", F.col("query_id").cast("string"))
    base, vectors = f"{shared_folder(spark)}/pools-{uuid.uuid4().hex}", fx.vectors(spark, sf_dir)
    search = lambda todo: pools_of(vectors, todo)
    sn.store_pools(asked.where("query_id % 3 = 0"), base, search)
    sn.store_pools(asked, base, search)
    return sn.pools_for(asked, base)
