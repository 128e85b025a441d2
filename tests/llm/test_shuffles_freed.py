"""Shuffle files of what is cut or written are gone afterwards, however many steps there are."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pathlib import Path
from time import sleep
from pyspark.sql import SparkSession
from ledgerline.llm.common import cut, written

spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").config("spark.local.dir", sys.argv[1])
         .config("spark.checkpoint.dir", sys.argv[1] + "/shared").getOrCreate())
rows = spark.range(2000, numPartitions=4).selectExpr("id % 100 as k", "id").repartition(6, "id")

def left():
    # Files are removed beside whatever runs next.
    for _ in range(50):
        files = len(list(Path(sys.argv[1]).rglob("shuffle_*.data")))
        if not files:
            break
        sleep(0.1)
    return files

counts = []
for way in (cut, written):
    kept = way(rows.repartition(6, "k"))
    counts.append(left())
    assert kept.count() == 2000 and kept.distinct().count() == 2000
    kept = way(kept.repartition(6, "k"))
    assert way(kept).count() == 2000
print("left", *counts, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None))
"""


def test_shuffle_files_go(tmp_path):
    env = os.environ | {"PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    print(done.stdout)
    assert done.stdout.split("left ")[1].split()[0] == "0"
