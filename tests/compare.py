"""Compare registered queries with their SQL on a data folder.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "item"):
        return cell(value.item())
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) for one query."""
    df = query(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(left)} rows, no SQL"
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    right = rows_of(columns, relation.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    if left != right:
        only_left, only_right = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        return False, f"{len(left)} against {len(right)} rows; {only_left} | {only_right}"
    return True, f"{len(left)} rows"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from mediasieve.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, statements, failed = connect(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, name, query, statements.get(name), sf_dir)
        except Exception as problem:  # noqa: BLE001
            ok, message = False, f"{type(problem).__name__}: {str(problem)[:900]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {message}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    print("statements without query:", sorted(set(statements) - set(queries())))
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
