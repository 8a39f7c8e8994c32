"""Run registered queries next to their SQL twins: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def open_tables(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _text(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    ours = canonical(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = canonical(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return None if not wrong else f"{len(wrong)} of {len(ours)} rows, e.g. {wrong[0]}"


def main() -> int:
    import __spark_entry__ as entry
    from trackloom.session import local

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local(8), open_tables(sf_dir), 0
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            verdict = difference(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None and not verdict.startswith("rows only")
        print(f"{name:34s} {time.time() - start:6.1f}s {verdict or 'equal'}", flush=True)
    print(f"{len(chosen)} queries, {bad} differing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
