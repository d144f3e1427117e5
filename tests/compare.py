"""Compare registered queries with their SQL twins: ``python tests/compare.py [sf_dir] [key…]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else float(value))
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        return _cell(value.item())
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))
    return [columns[i] for i in order], out


def kinds(rows):
    """Kind of value per column, to catch an integer beside a float."""
    found = {}
    for row in rows:
        for i, x in enumerate(row):
            if x is not None:
                found.setdefault(i, set()).add(type(x).__name__)
    return found


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    names, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    other_names = [d[0] for d in result.description]
    other_names, theirs = _rows(other_names, result.fetchall())
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference\n   spark {a}\n   sql   {b}"
    if kinds(mine) != kinds(theirs):
        return f"kinds {kinds(mine)} vs {kinds(theirs)}"
    return None if mine else "empty"


def main():
    from linkops.catalog import oracles, registered
    from linkops.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    con.execute("SET TimeZone='UTC'")
    sqls, bad = oracles(), 0
    for key, fn in registered().items():
        if wanted and not any(w in key for w in wanted):
            continue
        start = time.time()
        try:
            if key in sqls:
                problem = compare(spark, con, fn, sqls[key], sf_dir)
            else:
                count = fn(spark, sf_dir).count()
                problem = None if count else "no rows"
        except Exception as e:  # report every failing query, then go on
            problem = "".join(traceback.format_exception_only(e))[-1200:]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.1f}s {key}{'' if key in sqls else ' (rows only)'}"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print("failed", bad)


if __name__ == "__main__":
    main()
