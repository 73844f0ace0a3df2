"""Run registered queries against their SQL: python tests/check.py [sf] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from geoweave.session import local_session  # noqa: E402
from tests.harness import compare, duck, type_differences  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    known, oracles = queries(), oracle_sql()
    names = [n for n in known if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = known[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                differing = type_differences(df, con, oracles[name])
                if differing:
                    print("     types", name, differing, flush=True)
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        status = "ok" if not problems else "FAIL"
        print(f"{status:5}{name:32}{time.time() - start:7.2f}s{'' if name in oracles else '  (rows only)'}", flush=True)
        for p in problems:
            failed.append(name)
            print("     ", p, flush=True)
    print("failed:", sorted(set(failed)))
