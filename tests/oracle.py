"""Compare a query with its SQL twin: columns, row count and every value."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else repr(float(v) + 0.0)
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return repr(int(v))
    return str(v)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    data = [[_plain(v) for v in pdf[c].astype(object)] for c in cols]
    return sorted(zip(*data), key=lambda r: tuple("" if v is None else v for v in r))


def kind(t: str) -> str:
    t = t.lower()
    for k, names in {
        "int": ("int", "bigint", "integer", "long", "smallint", "tinyint"), "float": ("double", "float"),
        "str": ("string", "varchar"), "bool": ("boolean",), "time": ("timestamp",),
    }.items():
        if any(t.startswith(n) for n in names):
            return k
    return t


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str | None:
    df = fn(spark, sf_dir)
    pdf = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if sql is None:
        return None if len(pdf) else "no rows"
    cur = con.execute(sql)
    types = {c[0]: str(c[1]) for c in cur.description}
    ref = pd.DataFrame(cur.fetchall(), columns=list(types), dtype=object)
    if sorted(pdf.columns) != sorted(ref.columns):
        return f"columns {sorted(pdf.columns)} != {sorted(ref.columns)}"
    mine = dict(df.dtypes)
    bad = {c: (mine[c], types[c]) for c in types if kind(mine[c]) != kind(types[c])}
    if bad:
        return f"types {bad}"
    if len(pdf) != len(ref):
        return f"rows {len(pdf)} != {len(ref)}"
    a, b = _rows(pdf), _rows(ref)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, columns {sorted(pdf.columns)}, first {diff[0]}"
    return None if len(pdf) else "no rows"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pickwise.session import get_spark

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_spark("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
