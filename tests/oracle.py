"""Compares queries with their SQL in DuckDB, the way the driver does: columns by name, rows without order."""

import datetime
import math
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, int) or hasattr(v, "as_integer_ratio"):
        return round(float(v), 6)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr), sorted(names)


def compare(spark, name, run, sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = run(spark, folder)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if names != theirs:
        return f"columns {names} and {theirs}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return None


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__
    from memlake.session import local_session

    spark = local_session()
    queries, sqls = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for n in sys.argv[2:] or queries:
        t = time.time()
        try:
            said = compare(spark, n, queries[n], sqls[n], sys.argv[1]) if n in sqls else f"no SQL; {queries[n](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:300].replace("\n", " ")
        print(n, "ok" if said is None else said, round(time.time() - t, 1), flush=True)
