"""Run registered queries against their SQL: ``python tests/run_queries.py FOLDER [name ...]``."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from checking import compare, connect  # noqa: E402


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, failed = entry.oracle_sql(), []
    for name, f in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = f(spark, folder)
            if name in oracles:
                verdict = compare(df, con, oracles[name]) or "ok"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            verdict = "ERROR " + "".join(traceback.format_exception_only(e))[:1500]
            if names:
                traceback.print_exc()
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
        if verdict != "ok" and not verdict.startswith("rows only"):
            failed.append(name)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
