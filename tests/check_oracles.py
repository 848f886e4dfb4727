"""Run registered queries against their DuckDB oracle: python tests/check_oracles.py [--sf 0.01] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(normal(r[c]) for c in names) for r in df.select(*names).collect()]


def oracle_rows(sf_dir, sql):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    relation = con.sql(sql)
    names, types = list(relation.columns), [str(t) for t in relation.types]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(normal(r[i]) for i in order) for r in relation.fetchall()]
    return [names[i] for i in order], rows, {names[i]: types[i] for i in order}


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT"}


def compare(spark, name, fn, sql, sf_dir):
    """Empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_names, got = spark_rows(df)
    if sql is None:
        return "" if got else "no rows", len(got)
    names, want, types = oracle_rows(sf_dir, sql)
    if got_names != names:
        return f"columns {got_names} != {names}", len(got)
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if SAME.get(kind, types[field.name]) != types[field.name]:
            return f"type of {field.name}: {kind} != {types[field.name]}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}", len(got)
    key = lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} rows differ, first {dict(zip(names, bad[0][0]))} oracle {dict(zip(names, bad[0][1]))}"
            if bad else ""), len(got)


def main():
    import __spark_entry__ as entry
    from wavetable.session import build_session
    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.01"
    wanted = [a for a in args if not a.startswith("--") and a != sf]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            problem, n = compare(spark, name, fn, oracles.get(name), f"/root/testdata/sf{sf}")
        except Exception as exc:  # keep going, report all
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        failed += bool(problem)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {kind:6s} {n:7d} rows {time.time() - began:6.1f}s {problem}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
