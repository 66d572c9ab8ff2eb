"""python tests/run_oracle.py [sf folder] [name ...]: run registered queries against their SQL."""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, duck_rows, mismatch, spark_rows  # noqa: E402


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = set(argv[1:])
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            got = spark_rows(fn(spark, folder))
            t1 = time.time()
            why = mismatch(got, duck_rows(con, oracles[name])) if name in oracles else None
            note = f"{len(got[1])} rows" + ("" if name in oracles else " (no sql)") + ("  EMPTY" if not got[1] else "")
        except Exception as e:  # noqa: BLE001
            t1, why, note = time.time(), f"{type(e).__name__}: {str(e)[:1500]}", ""
            if "-v" in argv:
                traceback.print_exc()
        print(f"{'FAIL' if why else 'ok  '} {name} {t1 - t0:.2f}s {time.time() - t1:.2f}s {note} {why or ''}", flush=True)
        if why:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
