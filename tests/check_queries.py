"""Command line check: python tests/check_queries.py [sf_dir] [name-part ...]"""

import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from compare import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from ratelens.queries import all_oracles, all_queries  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ratelens-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = all_oracles()
    for name, run in sorted(all_queries().items()):
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, run, oracles[name], sf_dir)
            else:
                result = f"rows only {run(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            result = "ERROR " + str(exc).split("JVM stacktrace")[0][:1500]
        print(f"{'  ' if result.startswith(('ok', 'rows')) else '!!'} {name}: {result} [{time.time() - start:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
