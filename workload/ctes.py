"""SQL building blocks of the checks, written independently of the Spark code."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every block that it names, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        text = CTES[name]
        for other in CTES:
            if other != name and other not in order and re.search(rf"\b{other}\b", text):
                visit_name(other)
        if name not in order:
            order.append(name)

    visit(body)
    if not order:
        return body
    recursive = "RECURSIVE " if any(name.endswith("_rec") for name in order) else ""
    # Blocks are computed once; several checks name a costly one more than once.
    kind = lambda name: "" if name.endswith("_rec") else "MATERIALIZED "
    blocks = ",\n".join(f"{name} AS {kind(name)}(\n{CTES[name]}\n)" for name in order)
    return f"WITH {recursive}{blocks}\n{body}"


def r6(sql: str, *columns: str) -> str:
    """Round the named columns of a statement to six places."""
    replaced = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return with_ctes(f"SELECT * REPLACE ({replaced}) FROM (\n{sql.strip()}\n) AS q")


cte("fx_lines", """
SELECT l_orderkey, (l_linenumber - 1) % 3 + 1 AS agent_id,
       round(10 * max(l_discount), 1) AS conf_raw,
       max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS z,
       max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS flag_n
FROM lineitem GROUP BY 1, 2
""")
cte("fx_panel", """
SELECT o.o_orderkey AS item_id, CAST(a.agent_id AS INTEGER) AS agent_id,
       o.o_orderstatus <> 'P' AS has_doc_ref, l.conf_raw,
       l.conf_raw IS NOT NULL AS valid_json,
       CAST(coalesce(l.z, 0) AS INTEGER) AS z,
       coalesce(l.conf_raw, CAST(0 AS DOUBLE)) AS conf,
       coalesce(l.flag_n = 1 AND l.conf_raw < 0.3, false) AS refused
FROM orders o CROSS JOIN (VALUES (1), (2), (3)) AS a(agent_id)
LEFT JOIN fx_lines l ON l.l_orderkey = o.o_orderkey AND l.agent_id = a.agent_id
""")
cte("fx_items", """
SELECT o_orderkey AS item_id, o_orderstatus <> 'P' AS has_doc_ref FROM orders
""")
cte("fx_sufficiency", """
SELECT o_orderkey AS item_id,
       CAST(CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 2
                 WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 1 ELSE 0 END AS INTEGER) AS verdict
FROM orders
""")
cte("fx_audit", """
SELECT item_id, agent_id, CAST(CASE WHEN agent_id % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS refusal_verdict
FROM fx_panel WHERE refused
""")
cte("fx_folds", """
SELECT item_id, has_doc_ref, CAST((rn + CASE WHEN has_doc_ref THEN n_false ELSE 0 END) % 10 AS INTEGER) AS fold_k
FROM (
  SELECT item_id, has_doc_ref,
         row_number() OVER (PARTITION BY has_doc_ref ORDER BY md5('42:' || item_id), item_id) - 1 AS rn,
         count(*) FILTER (WHERE NOT has_doc_ref) OVER () AS n_false
  FROM fx_items)
""")
cte("fx_perm", """
SELECT CAST(f AS INTEGER) AS f, row_number() OVER (ORDER BY md5('42:' || f)) AS p FROM range(10) AS r(f)
""")
cte("fx_roles", """
SELECT exec_k, fold_k, CASE WHEN exec_k = fold_k THEN 'test' WHEN pos <= 2 THEN 'val' ELSE 'fit' END AS role
FROM (
  SELECT e.f AS exec_k, p.f AS fold_k,
         count(*) FILTER (WHERE p.f <> e.f) OVER (PARTITION BY e.f ORDER BY p.p) AS pos
  FROM fx_perm e CROSS JOIN fx_perm p)
""")
cte("fx_fpanel", """
SELECT p.*, f.fold_k FROM fx_panel p JOIN fx_folds f USING (item_id)
""")
cte("fx_sums", """
SELECT exec_k, agent_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s
FROM (SELECT fold_k, agent_id, count(*) AS n, sum(z) AS s FROM fx_fpanel GROUP BY 1, 2) f
JOIN fx_roles r USING (fold_k) WHERE r.role = 'fit' GROUP BY 1, 2
""")
cte("fx_alphas", """
SELECT exec_k, max(CASE WHEN agent_id = 1 THEN CAST(s AS DOUBLE) / n END) AS a1,
       max(CASE WHEN agent_id = 2 THEN CAST(s AS DOUBLE) / n END) AS a2,
       max(CASE WHEN agent_id = 3 THEN CAST(s AS DOUBLE) / n END) AS a3
FROM fx_sums GROUP BY 1
""")
cte("fx_weights", """
SELECT s.exec_k, s.agent_id, CAST(s.s AS DOUBLE) / s.n AS alpha,
       CASE WHEN (a1 + a2) + a3 = 0 THEN CAST(1 AS DOUBLE) / 3
            ELSE (CAST(s.s AS DOUBLE) / s.n) / ((a1 + a2) + a3) END AS weight,
       s.n AS fit_size
FROM fx_sums s JOIN fx_alphas a USING (exec_k)
""")
cte("fx_levels", """
SELECT exec_k, agent_id, conf AS x, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s
FROM (SELECT fold_k, agent_id, conf, count(*) AS n, sum(z) AS s FROM fx_fpanel GROUP BY 1, 2, 3) f
JOIN fx_roles r USING (fold_k) WHERE r.role = 'fit' GROUP BY 1, 2, 3
""")
cte("fx_cumlevels", """
SELECT exec_k, agent_id, x, n, s,
       row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs
FROM fx_levels WINDOW w AS (PARTITION BY exec_k, agent_id ORDER BY x)
""")
cte("fx_pooled", """
SELECT a.exec_k, a.agent_id, a.i AS lo, b.i AS hi,
       CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m
FROM fx_cumlevels a JOIN fx_cumlevels b
  ON a.exec_k = b.exec_k AND a.agent_id = b.agent_id AND b.i >= a.i
""")
cte("fx_isotonic", """
SELECT exec_k, agent_id, x, n, s, max(least_m) AS y
FROM (
  SELECT l.exec_k, l.agent_id, l.x, l.n, l.s, p.lo, min(p.m) AS least_m
  FROM fx_cumlevels l JOIN fx_pooled p
    ON p.exec_k = l.exec_k AND p.agent_id = l.agent_id AND p.lo <= l.i AND p.hi >= l.i
  GROUP BY 1, 2, 3, 4, 5, 6)
GROUP BY 1, 2, 3, 4, 5
""")
cte("fx_calibration", """
SELECT exec_k, agent_id, conf,
       CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL THEN lo.y WHEN lo.x = hi.x THEN lo.y
            ELSE lo.y + (hi.y - lo.y) / (hi.x - lo.x) * (conf - lo.x) END AS conf_calib
FROM (
  SELECT e.exec_k, c.agent_id, c.conf, max_by(struct_pack(x := i.x, y := i.y), i.x) FILTER (WHERE i.x <= c.conf) AS lo,
         min_by(struct_pack(x := i.x, y := i.y), i.x) FILTER (WHERE i.x >= c.conf) AS hi
  FROM (SELECT DISTINCT agent_id, conf FROM fx_panel) c
  CROSS JOIN (SELECT DISTINCT exec_k FROM fx_roles) e
  JOIN fx_isotonic i ON i.agent_id = c.agent_id AND i.exec_k = e.exec_k
  GROUP BY 1, 2, 3)
""")
cte("fx_scored", """
SELECT p.item_id, p.agent_id, p.has_doc_ref, p.fold_k, r.exec_k, r.role, p.conf, p.z, p.refused,
       w.alpha, w.weight, c.conf_calib, w.weight * c.conf_calib AS score
FROM fx_fpanel p JOIN fx_roles r ON r.fold_k = p.fold_k AND r.role IN ('val', 'test')
JOIN fx_weights w ON w.exec_k = r.exec_k AND w.agent_id = p.agent_id
JOIN fx_calibration c ON c.exec_k = r.exec_k AND c.agent_id = p.agent_id AND c.conf = p.conf
""")
cte("fx_heads", """
SELECT exec_k, role, item_id, has_doc_ref, agent_id AS agent_chosen, z AS z_winner, 1 - score AS eta
FROM (SELECT *, row_number() OVER (PARTITION BY exec_k, role, item_id
        ORDER BY score DESC, weight DESC, agent_id DESC) AS rn FROM fx_scored)
WHERE rn = 1
""")
cte("fx_grid", """
SELECT CAST(c AS DOUBLE) AS c_min FROM (VALUES (0.5), (0.7), (0.9)) AS g(c)
""")
cte("fx_candidates", """
SELECT exec_k, tau, sum(n) OVER w AS answered, sum(err) OVER w AS errors, sum(n) OVER (PARTITION BY exec_k) AS val_size
FROM (
  SELECT exec_k, tau, sum(n) AS n, sum(err) AS err FROM (
    SELECT exec_k, eta AS tau, 1 AS n, 1 - z_winner AS err FROM fx_heads WHERE role = 'val'
    UNION ALL SELECT DISTINCT exec_k, CAST(1 AS DOUBLE), 0, 0 FROM fx_heads)
  GROUP BY 1, 2)
WINDOW w AS (PARTITION BY exec_k ORDER BY tau)
""")
cte("fx_thresholds", """
SELECT exec_k, c_min, tau AS tau_star, coverage AS coverage_emp_val, risk AS risk_sel_emp_val,
       val_size, true AS constraint_satisfied
FROM (
  SELECT exec_k, c_min, tau, CAST(val_size AS BIGINT) AS val_size,
         CAST(answered AS DOUBLE) / val_size AS coverage, CAST(errors AS DOUBLE) / answered AS risk,
         row_number() OVER (PARTITION BY exec_k, c_min
           ORDER BY CAST(errors AS DOUBLE) / answered, CAST(answered AS DOUBLE) / val_size DESC, tau) AS rn
  FROM fx_candidates CROSS JOIN fx_grid
  WHERE answered > 0 AND CAST(answered AS DOUBLE) / val_size >= c_min)
WHERE rn = 1
""")
cte("fx_decisions", """
SELECT h.exec_k, h.item_id, h.has_doc_ref, h.agent_chosen, h.z_winner, h.eta, t.c_min, t.tau_star,
       h.eta > t.tau_star AS abstained, CASE WHEN h.eta > t.tau_star THEN NULL ELSE h.z_winner END AS z_system
FROM fx_heads h JOIN fx_thresholds t USING (exec_k) WHERE h.role = 'test'
""")
cte("fx_mean_head", """
SELECT item_id, has_doc_ref, agent_chosen, z_winner, 1 - ((c1 + c2) + c3) / 3 AS eta
FROM (
  SELECT item_id, any_value(has_doc_ref) AS has_doc_ref,
         max(CASE WHEN agent_id = 1 THEN conf END) AS c1, max(CASE WHEN agent_id = 2 THEN conf END) AS c2,
         max(CASE WHEN agent_id = 3 THEN conf END) AS c3,
         max(CASE WHEN rn = 1 THEN agent_id END) AS agent_chosen, max(CASE WHEN rn = 1 THEN z END) AS z_winner
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, agent_id) AS rn FROM fx_panel)
  GROUP BY item_id)
""")
