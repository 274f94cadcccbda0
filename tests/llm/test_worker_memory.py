"""Python workers live on beside the executor's next stages: what they keep counts there."""

import json
import subprocess
import sys

import pytest

#: Runs a stage in one worker of a new session; then that worker tells how many MB it has, and how many once freed memory is given back.
SCRIPT = """
import ctypes, json, os, re, sys
import pyarrow as pa
from pyspark.sql import SparkSession
import corpus_pipeline

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()

def kept(batches):
    for _ in batches:
        pass
    mb = lambda: sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
    found = [mb()]
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": found, "used": [mb()]})

def worker():
    return list(spark.range(1).coalesce(1).mapInArrow(kept, "pid long, mb long, used long").collect()[0])

docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
before = worker()
dict(corpus_pipeline.STAGES)[sys.argv[1]](spark, docs, "").write.format("noop").mode("overwrite").save()
print("KEPT", json.dumps([before, worker()]))
"""


@pytest.mark.parametrize("stage", ["language_id", "bpe"])
def test_workers_give_freed_memory_back(stage):
    ran = subprocess.run([sys.executable, "-c", SCRIPT, stage], capture_output=True, text=True, timeout=300, check=True)
    (pid, _, _), (same, kept, used) = json.loads(ran.stdout.rpartition("KEPT")[2])
    assert pid == same
    assert kept - used < 10
