"""python tests/run_checks.py [folder] [name prefix ...]: compare registered queries with their SQL."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_module
from compare import check, connect
from tallyloom.session import build_session

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    spark = build_session()
    con = connect(folder)
    oracle = entry_module.oracle_sql()
    bad = 0
    for name, build in entry_module.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            took, n, problem = check(spark, con, name, build, oracle.get(name), folder)
        except Exception as e:  # report and go on with the next query
            took, n, problem = 0, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "FAIL" if problem else ("ok" if name in oracle else "rows")
        if problem or n == 0:
            bad += bool(problem)
        print(f"{mark:5} {name:28} {took:6.2f}s {n:8d} rows {problem or ''}", flush=True)
    print("failed:", bad)
    spark.stop()
