"""Run registered queries against the oracle: python tests/check.py FOLDER [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from gristmill.queries import REGISTRY
from oracle import compare, connect


def main(folder, names):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in names or REGISTRY:
        start = time.time()
        try:
            query = REGISTRY[name]
            df = query(spark, folder)
            if query.sql is None:
                outcome = f"rows only: {df.count()}"
            else:
                outcome = compare(df, db, query.sql) or f"ok ({df.count()} rows)"
                failed += not outcome.startswith("ok")
        except Exception as error:
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
            failed += 1
        print(f"{name:28s} {time.time() - start:6.2f}s  {outcome}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
