"""Compare registered queries with their SQL: ``python tests/check.py [sf_dir] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from chatloom import session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session.build("local[8]", 8)
    con = oracle.connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                t1 = time.time()
                msg = oracle.diff(df, con, sqls[name])
                state = "ok" if msg is None else "DIFF " + msg[:900]
            else:
                state = f"rows {len(df.collect())}"
        except Exception as exc:  # report and go on
            state = "FAIL " + str(exc)[:700]
        bad += state[:2] not in ("ok", "ro")
        print(f"{name:28s} {time.time() - t0:6.2f}s {state}", flush=True)
    print("bad:", bad)
    assert set(sqls) <= set(queries)
