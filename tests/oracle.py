"""Compare registered queries with their SQL: python tests/oracle.py DIR NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x: object) -> str:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


def difference(spark, sf_dir: str, name: str) -> str | None:
    """None where rows agree, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    res = connect(sf_dir).execute(e.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    order = [cols.index(c) for c in names]
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in res.fetchall())
    if mine == theirs:
        return None
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} rows against {len(theirs)}; columns {names}; only here {list(a)[:2]}; only there {list(b)[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or e.queries():
        began = time.time()
        try:
            if name in e.oracle_sql():
                said = difference(spark, sys.argv[1], name)
            else:
                said = f"no SQL; {e.queries()[name](spark, sys.argv[1]).count()} rows"
        except Exception as problem:  # the others are still compared
            said = f"failed: {str(problem)[:300]}"
        print(name, "ok" if said is None else said, f"{time.time() - began:.1f} s", flush=True)
