"""Run registered queries beside their SQL and compare rows, names, types and values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        col = pdf[c]
        if col.dtype == object:
            pdf[c] = col.map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
        else:
            pdf[c] = pd.to_numeric(col.astype("float64"), errors="coerce") if col.dtype != bool else col.astype("float64")
    return pdf.sort_values(list(pdf.columns), kind="mergesort").reset_index(drop=True)


def type_name(t: str) -> str:
    t = str(t)
    return {"large_string": "string", "large_list": "list"}.get(t, t)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text when both sides agree, else what differs."""
    ours_arrow = spark_df.toArrow()
    theirs_arrow = con.sql(sql).to_arrow_table() if hasattr(con.sql("select 1"), "to_arrow_table") else con.sql(sql).arrow()
    a_types = {f.name: type_name(f.type) for f in ours_arrow.schema}
    b_types = {f.name: type_name(f.type) for f in theirs_arrow.schema}
    notes = []
    if a_types != b_types:
        diff = {k: (a_types.get(k), b_types.get(k)) for k in a_types.keys() | b_types.keys() if a_types.get(k) != b_types.get(k)}
        notes.append(f"types {diff}")
        if set(a_types) != set(b_types):
            return "; ".join(notes)
    a, b = normal(ours_arrow.to_pandas()), normal(theirs_arrow.to_pandas())
    if len(a) != len(b):
        return "; ".join(notes + [f"rows {len(a)} vs {len(b)}"])
    for c in a.columns:
        if a[c].dtype == object or b[c].dtype == object:
            bad = a[c].astype(str) != b[c].astype(str)
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            notes.append(f"{c}: {int(bad.sum())} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}")
            break
    return "; ".join(notes)


def main() -> None:
    from quorate.session import local_session

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                result = compare(df, con, oracles[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as e:
            result = "ERROR " + str(e).strip()[:700]
        if not (result == "ok" or result.startswith("rows only")):
            failed += 1
        print(f"{name:32s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
