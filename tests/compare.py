"""Runs named queries against their SQL in DuckDB. Also `python tests/compare.py SF_DIR NAME...`."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def _plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, int):
        return float(x) if abs(x) < 1 << 53 else x
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return tuple((k, _plain(v)) for k, v in x.asDict().items())
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def differences(spark, sf_dir: str, name: str, query, sql: str, con=None) -> str:
    """'' where the rows agree."""
    con = con or duck(sf_dir)
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    got = con.execute(sql)
    theirs_columns = [d[0] for d in got.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} and {sorted(theirs_columns)}"
    at = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in got.fetchall())
    if ours == theirs:
        return ""
    only, other = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(only)[:3]}; only SQL {list(other)[:3]}"


def main() -> None:
    import time

    import __spark_entry__ as e

    from storyloom.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    con = duck(sys.argv[1])
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            if name in sqls:
                said = differences(spark, sys.argv[1], name, queries[name], sqls[name], con) or "agrees"
            else:
                said = f"{queries[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
