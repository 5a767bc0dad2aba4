import subprocess
import sys
from pathlib import Path

FIT = """
import re, sys
from pathlib import Path
import numpy as np
from pyspark.sql import SparkSession
from ledgerloom.llm import toxicity

spark = SparkSession.builder.config(map={"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}).getOrCreate()
rng = np.random.default_rng(3)
vocab = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20000, 8))])

def used(n):
    texts = [(i, " ".join(rng.choice(vocab, 500))) for i in range(n)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{sys.argv[1]}/{n}")
    del texts
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    model = toxicity.fit(spark.read.parquet(f"{sys.argv[1]}/{n}"), labels, epochs=1)
    assert (model.folded != 0).any()
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

print("MB", used(200), used(1500))
"""


def test_fit_leaves_little_in_the_driver(tmp_path):
    """The stages behind the classifier share the driver with what its training leaves there."""
    run = subprocess.run([sys.executable, "-c", FIT, str(tmp_path)], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    few, many = map(float, run.stdout.split("MB ")[1].split())
    assert many < few + 40, (few, many)
