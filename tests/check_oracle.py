"""Run every registered query against its oracle: python tests/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402

from vigil.plans.catalog import ORACLE, QUERIES  # noqa: E402
from vigil.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          extra={"spark.driver.memory": "8g",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="vigil-ckpt-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLE:
                problems, rows = compare(df, con, ORACLE[n])
            else:
                rows, problems = df.count(), ["(rows only)"]
        except Exception as e:  # report and continue
            problems, rows = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1
        ok = not problems or problems == ["(rows only)"]
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:32s} rows={rows:<7} {time.time()-t:6.2f}s {'; '.join(problems)}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
