"""Compare registered queries with their DuckDB SQL: ``python tests/oracle_check.py <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, con, name, query, sql, sf_dir):
    """None if equal, else a short description."""
    frame = query(spark, sf_dir)
    found = rows_by_name(frame.columns, [tuple(r) for r in frame.collect()])
    relation = con.execute(sql)
    wanted = rows_by_name([d[0] for d in relation.description], relation.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} != {wanted[0]}"
    extra, missing = found[1] - wanted[1], wanted[1] - found[1]
    if extra or missing:
        return (f"{found[1].total()} rows, wanted {wanted[1].total()}; "
                f"extra {list(extra)[:2]}; missing {list(missing)[:2]}")
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    expected = {d[0]: SPARK_TYPES.get(str(d[1]), str(d[1])) for d in relation.description}
    return None if types == expected else f"types {types} != {expected}"


SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
               "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def main():
    import __spark_entry__ as entry
    from tests.conftest import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, sqls = session(), connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        if name not in sqls:
            print(f"{name}: {query(spark, sf_dir).count()} rows, no oracle")
            continue
        try:
            problem = difference(spark, con, name, query, sqls[name], sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name}: {'ok' if problem is None else 'DIFFERENT ' + problem} ({time.time() - start:.1f} s)", flush=True)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
