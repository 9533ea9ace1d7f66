"""Compare registered queries with their SQL, strictly by value and type."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float" if isinstance(value, float) else "decimal"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return type(value).__name__
    return type(value).__name__


def _rows(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            cells.append((_kind(v), "nan" if v != v else repr(v + 0.0 if isinstance(v, float) else v)))
        out.append(tuple(cells))
    return sorted(out)


_SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir: str, build, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = build(spark, sf_dir)
    got_names = df.columns
    got = _rows(df.collect(), got_names)
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want_types = [str(c[1]) for c in cur.description]
    want = _rows(cur.fetchall(), want_names)
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    types = dict(df.dtypes)
    for name, kind in zip(want_names, want_types):
        if _SQL_TYPES.get(kind, kind) != types[name]:
            return f"type of {name}: {types[name]} != {kind}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows to compare"
    for a, b in zip(got, want):
        if a != b:
            n = sum(x != y for x, y in zip(got, want))
            return f"{n} rows differ, first {a} != {b}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    from apptlens.session import build_session

    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="10g",
        spark__ui__showConsoleProgress="false",
    )
    for setting in os.environ.get("EXTRA_CONF", "").split():
        spark.conf.set(*setting.split("=", 1))
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    names = [q for n in names for q in ([n] if n in queries else [q for q in queries if queries[q].__module__.endswith(n)])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                rows = len(queries[name](spark, sf_dir).collect())
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows)'} {problem or ''}", flush=True)
    print(f"{len(names)} checked, {bad} bad")


if __name__ == "__main__":
    main()
