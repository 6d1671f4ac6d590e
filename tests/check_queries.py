"""Compare registered queries with their check SQL: ``python tests/check_queries.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from compare import compare, oracle_connection  # noqa: E402

import brickline.catalog as catalog  # noqa: E402
from brickline.session import local_session  # noqa: E402


def main(names):
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    failed = []
    for name, fn in catalog.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in catalog.ORACLES:
                result = compare(df, con, catalog.ORACLES[name])
            else:
                n = len(df.collect())
                result = f"" if n else "no rows"
        except Exception as e:  # a failing query must not hide the others
            result = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - start
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{'ok  ' if not result else 'FAIL'} {kind} {took:6.2f}s {name} {result[:1200]}", flush=True)
        if result:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
