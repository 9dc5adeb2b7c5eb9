"""Run registered queries next to their SQL and compare rows, columns and values.

    python -m conformance.compare [sf folder] [query ...]
"""

from __future__ import annotations

import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sortable(row):
    return tuple((v is None, str(v)) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns and the same values."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return [f"columns {columns} != {sorted(names)}"]
    actual = [tuple(row[c] for c in columns) for row in df.collect()]
    at = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in at) for row in expected]
    if len(actual) != len(expected):
        return [f"{len(actual)} rows != {len(expected)}"]
    out = []
    for a, b in zip(sorted(actual, key=_sortable), sorted(expected, key=_sortable)):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            out.append(f"{dict(zip(columns, a))} != {dict(zip(columns, b))}")
    return out


def main() -> None:
    from conformance.queries import ORACLES, QUERIES
    from txnrisk.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                found = differences(df, con, ORACLES[name])
                status = "ok" if not found else f"DIFF {len(found)}: {found[0]}"
            else:
                status = f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            status = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - started:7.2f}s  {status}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
