"""Compare registered queries with their SQL: ``python tests/compare.py [-s 0.01] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


# Queries that SQL cannot express; each has a test against a plain version.
TESTED_ELSEWHERE = {
    "provenance_records", "pipeline",
    "op2_html_text", "op3_langid", "op4_lattice", "op5_token_counts", "op6_token_files", "op8_quality", "op9_simhash", "op10_decontamination", "op11_licenses",
}


def _family(text: str) -> str:
    text = text.lower()
    if text.startswith("decimal") or text == "hugeint":
        return "decimal"
    return {"varchar": "string", "integer": "int", "timestamp_ntz": "timestamp"}.get(text, text)


def compare(spark, con, folder, name, run, sql):
    """Return (same, message)."""
    start = time.time()
    df = run(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    names, got = canonical(df.columns, spark_rows)
    if sql is None:
        return bool(got) and name in TESTED_ELSEWHERE, f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    sql_names, want = canonical([d[0] for d in cur.description], cur.fetchall())
    types = {n: _family(t) for n, t in df.dtypes}
    sql_types = {d[0]: _family(str(d[1])) for d in con.execute(sql).description}
    odd = {n: (types[n], sql_types.get(n)) for n in types if types[n] != sql_types.get(n)}
    note = f"{len(got)}/{len(want)} rows, {took:.1f}s vs {time.time() - start:.1f}s" + (f" TYPES {odd}" if odd else "")
    if names != sql_names:
        return False, f"columns {names} vs {sql_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 300000 else []
        lacking = [r for r in want if r not in set(got)][:2] if len(got) < 20000 else []
        return False, f"{note}; only Spark {extra}; only SQL {lacking}"
    if odd:
        return False, note
    # On the smallest data some queries rightly find nothing, as their SQL does.
    return bool(got) or folder.endswith("sf0.001"), note + ("" if got else " EMPTY")


def main(argv):
    import __spark_entry__ as entry
    from strandline.session import build_session

    scale = "0.01"
    if argv and argv[0] == "-s":
        scale, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{scale}"
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    runs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in runs:
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        try:
            same, note = compare(spark, con, folder, name, runs[name], sqls.get(name))
        except Exception as e:
            same, note = False, f"{type(e).__name__}: {str(e)[:600]}"
            if "stopped SparkContext" in str(e) or "OutOfMemory" in str(e):
                print("BAD " + name + ": " + note)
                return 1
        bad += not same
        print(("ok  " if same else "BAD ") + name + ": " + note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
