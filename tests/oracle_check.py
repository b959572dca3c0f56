"""Compare registered queries with their SQL on one scale: python tests/oracle_check.py [sf_dir] [names...]"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when both sides agree, otherwise a short description of the difference."""
    df = query(spark, sf_dir)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_cols, want = table(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w) and not same(g, w)]
    return None if not bad else f"{len(bad)} of {len(got)} rows differ in {got_cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}"


def same(g, w):
    return all(a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and float(a) == float(b)) for a, b in zip(g, w))


def main(argv):
    import __spark_entry__ as entry
    from evidence_spark import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                diff = None if queries[name](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.1f}s{'' if name in oracles else ' (rows only)'}{'' if diff is None else ' ' + diff}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
