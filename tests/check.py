"""Run queries against their SQL: python tests/check.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest import make_session  # noqa: E402
from oracle import connect, differences  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1]
    spark = make_session()
    con = connect(sf)
    oracles = oracle_sql()
    bad = 0
    for name, build in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = build(spark, sf)
            if name in oracles:
                issues = differences(df, con, oracles[name])
            else:
                issues = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            issues = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(issues)
        print(f"{'FAIL' if issues else 'ok'} {name} {time.time() - start:.2f}s {issues or ''}", flush=True)
    print("failed:", bad)
