"""Run registered queries against their SQL twins: ``python tests/compare.py [sf] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    return value


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def compare(spark, con, name: str, sf_dir: str, query, sql: str) -> str | None:
    """None when both agree, otherwise what differs."""
    df = query(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}; first {mine[1][:2]} / {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, e.g. {bad[:2]}" if bad else None


def main() -> None:
    import __spark_entry__ as contract
    from tapewarden.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    wanted = sys.argv[2:]
    spark, con = local_session(cores=8), connect(sf_dir)
    oracles = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, name, sf_dir, query, oracles[name]) or "ok"
            else:
                verdict = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
