"""python tests/check.py [name ...]: run queries against their oracle and print timings."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from fleetwatt.session import local_session  # noqa: E402

if __name__ == "__main__":
    spark = local_session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = oracle.duck()
    for name in sys.argv[1:] or qs:
        t = time.time()
        try:
            df = qs[name](spark, oracle.SF)
            msg = oracle.compare(df, sqls[name], con) if name in sqls else f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
