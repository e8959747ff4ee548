"""Compare registered queries with their DuckDB twins: python -m tests.compare [sf] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def kind(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "int"
    if t in ("double", "float", "real") or t.startswith("decimal"):
        return "float"
    if t in ("string", "varchar"):
        return "text"
    return t


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    got = fn(spark, sf_dir)
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return f"rows {len(mine)}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"COLUMNS {sorted(got.columns)} / {sorted(names)}"
    described = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    types = {f.name: kind(f.dataType.simpleString()) for f in got.schema}
    bad = {c: (types[c], described[c]) for c in types if types[c] != described[c]}
    note = f" TYPES {bad}" if bad else ""
    if mine == theirs:
        return f"ok {len(mine)}{note}" if mine else f"EMPTY{note}"
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    diff = f"DIFF {len(mine)} / {len(theirs)} rows, only spark {len(a - b)}, only duck {len(b - a)}{note}"
    for x in sorted(a - b)[:2]:
        diff += f"\n   S {x[:700]}"
    for x in sorted(b - a)[:2]:
        diff += f"\n   D {x[:700]}"
    return diff


def main() -> None:
    import __spark_entry__ as entry
    from lawloom.session import local_session

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not any(name == p or name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            out = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            out = "ERROR " + str(e)[:900]
        print(f"{name:32s} {time.time() - t:6.1f}s {out}", flush=True)


if __name__ == "__main__":
    main()
