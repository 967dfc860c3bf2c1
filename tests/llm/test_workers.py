"""What an operator leaves in a Python worker, in a session whose one worker has done nothing else."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import json, re, sys
import pyarrow as pa
from pathlib import Path
from pyspark.sql import functions as F
from marginloom.llm import bpe, language
from marginloom.llm.queries import vocabulary
from marginloom.session import build_session

spark = build_session("worker", **{"spark.master": "local[1]", "spark.sql.shuffle.partitions": "1",
                                   "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
words = F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.concat(
    F.lit("w"), F.pmod(F.xxhash64(F.col("id"), i), F.lit(5000)).cast("string")))
docs = spark.range(3000, numPartitions=1).select(
    F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"), F.element_at(
        F.array(F.lit("en"), F.lit("de")), (F.col("id") % 2 + 1).cast("int")).alias("lang"))
found = {"bpe": lambda: bpe.encode_documents(docs.select("doc_id", "text"), vocabulary()),
         "language": lambda: language.identify(docs, ["doc_id", "text"])}[sys.argv[1]]()
found.write.format("noop").mode("overwrite").save()

def held(batches):
    widest = max(b.nbytes for b in batches)
    stays = re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())
    yield pa.RecordBatch.from_arrays([pa.array([widest]), pa.array([int(stays[1]) * 1024])], ["widest", "stays"])

probe = spark.range(1).mapInArrow(held, "widest long, stays long").first()
batch = docs.mapInArrow(held, "widest long, stays long").first()
print(json.dumps([batch["widest"], probe["stays"]]))
"""


@pytest.mark.parametrize("operator", ["bpe", "language"])
def test_workers_take_bounded_batches_and_give_memory_back(operator):
    done = subprocess.run([sys.executable, "-c", CODE, operator], cwd=ROOT, capture_output=True, text=True, timeout=240,
                          env=os.environ | {"PYTHONPATH": ROOT, "TZ": "UTC"})
    assert done.returncode == 0, done.stderr[-2000:]
    widest, stays = json.loads(done.stdout.splitlines()[-1])
    assert widest < 8 << 20
    assert stays < 180 << 20
