"""Run registered queries in Spark and their SQL in DuckDB; compare results.

Comparison: same column names, same row count, and the same multiset of rows
(columns sorted by name, floats rounded to 9 digits).
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from citeline.sources.tables import TABLES


def duck(base: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return con


def _norm_rows(pdf):
    import math

    import pandas as pd

    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or v is pd.NA:     # DuckDB's nullable integers
            return None
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        if isinstance(v, dict):
            return tuple(sorted((k, norm(x)) for k, x in v.items()))
        if hasattr(v, "isoformat"):
            return v.isoformat(sep=" ")
        return v

    rows = [tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def compare(spark, name: str, base: str, con=None) -> dict:
    from citeline.plans.catalog import ORACLE, QUERIES
    con = con or duck(base)
    t0 = time.time()
    sdf = QUERIES[name](spark, base).toPandas()
    t1 = time.time()
    out = {"query": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        out["status"] = "no-oracle"
        return out
    ddf = con.sql(ORACLE[name]).df()
    out["duck_rows"] = len(ddf)
    out["duck_sec"] = round(time.time() - t1, 2)
    sc, sr = _norm_rows(sdf)
    dc, dr = _norm_rows(ddf)
    if sc != dc:
        out["status"] = f"columns differ: {sc} vs {dc}"
    elif sr != dr:
        diff = [r for r in sr if r not in set(dr)][:2]
        out["status"] = "values differ"
        out["example"] = repr(diff)[:600]
        out["duck_example"] = repr([r for r in dr if r not in set(sr)][:2])[:600]
    else:
        out["status"] = "ok"
    return out


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    from citeline.plans.catalog import QUERIES
    from citeline.session import local_session
    spark = local_session()
    con = duck(a.sf_dir)
    bad = 0
    for n in a.names or sorted(QUERIES):
        try:
            r = compare(spark, n, a.sf_dir, con)
        except Exception as e:  # report and continue with the next query
            r = {"query": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("ok", "no-oracle")
        print(json.dumps(r, ensure_ascii=False), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
