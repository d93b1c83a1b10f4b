"""Run a registered query on Spark and its oracle SQL on DuckDB; compare.

Usable from pytest and as a script:
    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    import __spark_entry__ as E
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
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    res["schema_match"] = sorted(s_cols) == sorted(d_cols)
    if not res["schema_match"]:
        res["spark_cols"], res["duck_cols"] = sorted(s_cols), sorted(d_cols)
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["match"] = res["schema_match"] and a == b
    if not res["match"] and res["schema_match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [repr(x)[:300] for x in list(sa - sb)[:3]]
        res["only_duck"] = [repr(x)[:300] for x in list(sb - sa)[:3]]
    return res


def main(argv):
    from evalspark.session import get_spark
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    import __spark_entry__ as E
    names = names or list(E.queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("match", r.get("oracle") == "none")
        bad += 0 if ok else 1
        print(json.dumps(r, ensure_ascii=False), flush=True)
    print(f"# {len(names) - bad}/{len(names)} ok", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
