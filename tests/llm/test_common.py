import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from pointlake.llm import bpe, dartminhash
from pointlake.llm.common import PART, in_parts

SCRIPT = """
import re
import pyarrow as pa
from pointlake.llm.common import PART, in_parts

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

held = [bytes(16_000) for _ in range(12_000)]
most, last = mb(), held[-1]
del held
free = mb()
got = list(in_parts([pa.array(range(PART + 1))]))
print(round(most), round(free), round(mb()), [len(x) for x in got])
"""


def test_parts():
    batches = [pa.array(range(2 * PART + 1)), pa.array([], pa.int64()), pa.array([None, 5], pa.int64())]
    got = list(in_parts(batches))
    assert [len(x) for x in got] == [PART, PART, 1, 0, 2]
    assert pa.concat_arrays(got).equals(pa.concat_arrays(batches))


def test_a_worker_gives_back_what_it_holds_free():
    got = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=120, check=True).stdout.split(None, 3)
    most, free, after = map(int, got[:3])
    assert free > most - 50 and after < most - 120


def test_batches_larger_than_a_part(spark):
    n = 2 * PART + 500
    docs = spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("a text of number "), "id", F.repeat(F.lit(" x"), (F.col("id") % 5).cast("int")))).alias("text"))
    text = lambda i: f"a text of number {i}" + " x" * (i % 5) if i % 7 else ""
    signed = dartminhash.with_signatures(docs, "text", "count", "s").select("doc_id", "s.key").collect()
    assert len(signed) == n and all(bytes(r.key) == dartminhash.set_key(dartminhash.occurrences(*dartminhash.weighted(text(r.doc_id)))) for r in signed)
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.digests(docs, with_ids=True).collect()
    assert len(encoded) == n and all(r.ids == plain.encode_ordinary(text(r.doc_id)) for r in encoded)
