"""Compare registered queries with their SQL twins.

    python tests/crosscheck.py SF_DIR [query ...]
"""
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of plain values, columns in name order."""

    def plain(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v.is_integer():
            return int(v)
        return v

    df = df[sorted(df.columns)]
    rows = [tuple(plain(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def differences(spark, con, sf_dir: str, name: str, queries, oracles) -> str | None:
    """None if equal, else what differs."""
    got = queries[name](spark, sf_dir).toPandas()
    want = con.execute(oracles[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    left, right = canonical(got), canonical(want)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first: {str(wrong[0])[:600]}"
    return None


def main() -> None:
    from conftest import build_session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = build_session(), connect(sf_dir)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, sf_dir, name, queries, oracles)
            else:
                rows = queries[name](spark, sf_dir).count()
                problem = None if rows else "no rows"
                name += " (rows only)"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
