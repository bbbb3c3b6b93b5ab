"""Run registered queries against their DuckDB oracle (as the driver does).

    python tests/oracle_check.py [sf_dir] [name ...]

Compares column names, row counts and the order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    sql = E.oracle_sql().get(name)
    if sql is None:
        res["oracle"] = "none"
        return res
    rel = con.sql(sql)
    o_cols = rel.columns
    o_rows = rel.fetchall()
    res["oracle_sec"] = round(time.time() - t1, 2)
    res["oracle_rows"] = len(o_rows)
    res["columns_match"] = sorted(s_cols) == sorted(o_cols)
    if not res["columns_match"]:
        res["columns"] = (s_cols, o_cols)
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    res["values_match"] = a == b
    if a != b:
        sa, sb = set(a), set(b)
        res["only_spark"] = sorted(sa - sb, key=str)[:3]
        res["only_oracle"] = sorted(sb - sa, key=str)[:3]
    return res


def main(argv):
    from quire.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E

    spark = local_session(8, "oracle-check", 8)
    con = duck(sf_dir)
    ok = True
    for n in names or list(E.queries()):
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:800]}
        good = r.get("values_match", r.get("oracle") == "none")
        ok &= bool(good)
        print(("OK  " if good else "BAD ") + str(r), flush=True)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
