"""What Python workers hold: caches of one kind of work, no unused memory."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard as J
from tidemark.llm.common import map_arrow


def test_caches_go_when_a_worker_turns_to_other_work(spark):
    """Workers that shingled texts hold no word hashes once they do something else; between tasks of shingling they do."""
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.lit("of many words")).alias("text"), F.col("id").alias("key")).repartition(16)

    def make():
        def step(batch):
            return pa.RecordBatch.from_arrays([pa.array([len(J._word_hashes)], pa.int64())], names=["held"])

        return step

    def held(make):
        J.shingled(docs, 3, J.Threshold(90, 100)).count()
        return max(r["held"] for r in map_arrow(docs, make, "held long").collect())

    make.__module__ = J.__name__
    assert held(make) > 0
    make.__module__ = __name__
    assert held(make) == 0


GIVEN_BACK = """
import random, re
import pyarrow as pa
from tidemark.llm import common, tokenizing
import public_tokenizers

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

class Docs:
    def mapInArrow(self, task, schema):
        return task

most = 0

def run(batches):
    global most
    cache = tokenizing.library_cache(public_tokenizers.path("byte_bpe_50k.json"))
    for batch in batches:
        ids = tokenizing.encode_spaced(cache, batch.column(0))
        most = max(most, mb())
        yield batch

draw = random.Random(1)
words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(5000)]
texts = pa.array([" ".join(draw.choices(words, k=300)) for _ in range(4000)])
batch = pa.RecordBatch.from_arrays([texts], names=["text"])
before = mb()
for _ in common.map_batches(Docs(), run, "text string")(iter([batch, batch, batch])):
    pass
print(most - before, mb() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_memory_is_given_back_after_a_task():
    """A task's batches leave little behind in its worker; the allocators would keep most of it."""
    most, left = map(int, subprocess.run([sys.executable, "-c", GIVEN_BACK], check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}).stdout.split())
    assert left < most / 2
