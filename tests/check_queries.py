"""Run registered queries against their SQL: ``python tests/check_queries.py [sf] [name ...]``."""
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import compare, connect  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from gridcast.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session(8)
con = connect(sf_dir)
bad = 0
sql = e.oracle_sql()
for name, run in e.queries().items():
    if names and name not in names:
        continue
    t = time.time()
    try:
        df = run(spark, sf_dir)
        faults = compare(df, con, sql[name]) if name in sql else [] if df.collect() else ["no rows"]
    except Exception as ex:
        faults = [f"{type(ex).__name__}: {str(ex)[:700]}"]
    bad += bool(faults)
    print(f"{'FAIL' if faults else 'ok  '} {name:28s} {time.time() - t:6.2f}s {'' if name in sql else '(rows only)'}", flush=True)
    for f in faults:
        print("     ", f[:1200], flush=True)
print("failed:", bad)
