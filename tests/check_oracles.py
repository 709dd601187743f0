"""Run registered queries in Spark and DuckDB side by side and compare them.

    python tests/check_oracles.py [sf dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, text):
    """None when equal, else a short description of the difference."""
    names = sorted(df.columns)
    got = Counter(tuple(canon(r[n]) for n in names) for r in df.collect())
    cur = con.execute(text)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    idx = [cols.index(n) for n in names]
    want = Counter(tuple(canon(r[i]) for i in idx) for r in cur.fetchall())
    if got == want:
        return None if got else "both empty"
    a, b = list((got - want).elements()), list((want - got).elements())
    return f"rows {sum(got.values())} vs {sum(want.values())}; {len(a)}/{len(b)} differ {names} spark={sorted(a, key=str)[:2]} duck={sorted(b, key=str)[:2]}"


def session(cores=8):
    from pyspark.sql import SparkSession
    from bourse.session import configured
    s = (configured(SparkSession.builder).master(f"local[{cores}]").appName("bourse-check")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(sf_dir)
    bad = []
    for key in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            res = compare(df, con, oracles[key]) if key in oracles else f"rows-only {df.count()}"
        except Exception as e:  # report and go on
            res = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        ok = res is None or res.startswith("rows-only")
        if not ok:
            bad.append(key)
        print(f"{'ok ' if ok else 'BAD'} {key:28s} {time.time() - start:6.2f}s {res or ''}", flush=True)
    print(f"{len(bad)} bad of {len(argv[1:] or queries)}: {bad}; {len(oracles)} oracles")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
