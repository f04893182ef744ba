"""Run registered queries against DuckDB: python tests/check.py [--sf DIR] [name or prefix ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from tickloom import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                note = "ok" if diff is None else "DIFF " + diff
            else:
                note = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if not note.startswith(("ok", "rows")):
            bad.append(name)
        print(f"{name:28s} {time.time() - t:6.2f}s {note[:900]}", flush=True)
    print(f"bad: {bad}; {len(queries)} queries, {len(sqls)} with SQL")


if __name__ == "__main__":
    main()
