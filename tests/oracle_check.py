"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare the results.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison mirrors the driver's: columns sorted by name, row count, order-insensitive values
(floats rounded to 6 decimals, timestamps as ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in records]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={s_cols} duck={d_cols}"
        return res
    a, b = Counter(rows_of(s_cols, s_rows)), Counter(rows_of(d_cols, d_rows))
    if a == b:
        res["status"] = "match"
    else:
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        res["status"] = f"MISMATCH spark-only={only_s} duck-only={only_d}"
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    bad_types = {c: (s_types[c], d_types[c]) for c in sorted(s_cols)
                 if DUCK_TO_SPARK.get(d_types[c], d_types[c].lower()) != s_types[c]}
    if bad_types:
        res["types"] = bad_types
        if res["status"] == "match":
            res["status"] = "match (TYPES differ)"
    return res


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
                 "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
                 "SMALLINT": "smallint", "TINYINT": "tinyint", "TIMESTAMP WITH TIME ZONE": "timestamp"}


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from gridlake.session import local_session

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, ors = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        try:
            r = compare(spark, con, name, qs[name], ors.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        if r["status"] == "match (TYPES differ)":
            ok = True
        bad += not ok
        print(("ok   " if ok else "FAIL ") + str(r), flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
