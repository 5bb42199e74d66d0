"""Command line check: python tests/check_all.py SF_DIR [name ...]"""

import sys
import time

sys.path.insert(0, "/root/repo")

import __spark_entry__ as entry  # noqa: E402
from tabloom.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

sf = sys.argv[1]
names = sys.argv[2:] or list(entry.queries())
spark = local_session()
con = connect(sf)
oracles = entry.oracle_sql()
bad = 0
for n in names:
    start = time.time()
    try:
        df = entry.queries()[n](spark, sf)
        if n in oracles:
            diff = differences(df, con, oracles[n])
            state = "ok" if not diff else "DIFF " + " | ".join(diff)
        else:
            state = f"rows {df.count()}"
    except Exception as e:  # noqa: BLE001
        state = f"ERROR {type(e).__name__}: {str(e)[:600]}"
    bad += state.startswith(("DIFF", "ERROR"))
    print(f"{time.time() - start:6.2f}s {n}: {state[:900]}", flush=True)
print("bad", bad, "of", len(names))
