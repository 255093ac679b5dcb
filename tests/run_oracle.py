"""Compare registered queries with their SQL twins: run_oracle.py [scale] [name part ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import connect, data_folder, difference  # noqa: E402


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tablewright.session import build_session

    scale, parts = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    folder = data_folder(scale)
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, build in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name in sql:
                started = time.time()
                result = con.execute(sql[name])
                names = [d[0] for d in result.description]
                problem = difference(df.columns, rows, names, result.fetchall())
                print(f"{'ok  ' if problem is None else 'FAIL'} {name:34s} {len(rows):7d} rows {took:6.2f}s sql {time.time() - started:5.2f}s {problem or ''}", flush=True)
            else:
                problem = None if rows else "no rows"
                print(f"{'rows' if rows else 'FAIL'} {name:34s} {len(rows):7d} rows {took:6.2f}s", flush=True)
            failed += problem is not None
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"FAIL {name:34s} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
