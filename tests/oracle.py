"""Compare a query with its SQL on one scale: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float):
        return None if x != x else int(x) if x == int(x) else round(x, 6)
    if hasattr(x, "tolist"):
        x = x.tolist()
        return plain(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    return x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} and {sorted(want.columns)}"]
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return [f"{len(a)} rows and {len(b)}"]
    return [f"{x}\n    {y}" for x, y in zip(a, b, strict=True) if repr(x) != repr(y)][:3]


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    from tests.conftest import session

    spark, sf = session(), f"/root/testdata/sf{sys.argv[1]}"
    have, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or have:
        t = time.time()
        try:
            if name in sql:
                bad = differences(spark, have[name], sql[name], sf)
                print(name, "OK" if not bad else "DIFFERS", f"{time.time() - t:.1f} s", *bad, sep="\n    " if bad else " ", flush=True)
            else:
                print(name, "rows", have[name](spark, sf).count(), f"{time.time() - t:.1f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", str(e)[:1500], flush=True)


if __name__ == "__main__":
    main()
