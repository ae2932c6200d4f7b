"""Run catalogue queries in Spark and their oracle SQL in DuckDB and compare.

Usage: python tests/oracle_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import pandas as pd
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist") and not isinstance(v, (int, float, str)):
        return _norm(v.tolist())
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if v.is_integer():
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


def type_diffs(sdf, con, sql):
    st = {f.name.lower(): SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
    rel = con.sql(sql)
    dt = {c.lower(): str(t) for c, t in zip(rel.columns, rel.types)}
    return [(c, st[c], dt.get(c)) for c in st if st[c] != dt.get(c)]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return f"{name}: spark rows={len(spdf)} (no oracle) {t1-t0:.1f}s", True
    td = type_diffs(sdf, con, sql)
    if td:
        return f"{name}: TYPES differ {td[:4]}", False
    dpdf = con.execute(sql).df()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    if sc != dc:
        return f"{name}: COLUMNS differ spark={sc} duck={dc}", False
    if len(sr) != len(dr):
        return f"{name}: ROWCOUNT spark={len(sr)} duck={len(dr)}", False
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{name}: VALUES differ in {len(bad)} rows, e.g. spark={bad[0][0]} duck={bad[0][1]}", False
    return f"{name}: OK rows={len(sr)} {t1-t0:.1f}s", True


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    from callscope.session import local_session
    import __spark_entry__ as E
    spark = local_session(8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    ok_all = True
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            msg, ok = compare(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}", False
        ok_all &= ok
        print(msg, flush=True)
    print("ALL OK" if ok_all else "FAILURES")


if __name__ == "__main__":
    main()
