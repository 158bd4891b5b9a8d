"""Every query runs where the workers can't import this package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# The driver finds the package by a path hook of its own, which the workers (PYTHONPATH, working folder) don't have.
SCRIPT = """
import os, sys
repo, names = sys.argv[1], sys.argv[2:]
sys.path.insert(0, repo)
os.environ.pop("PYTHONPATH", None)
from costlens.session import get_session
spark = get_session(master="local[4]", shuffle_partitions=4)

def missing(batches):
    try:
        import costlens.llm.lm
        told = "found"
    except ImportError:
        told = "missing"
    import pyarrow as pa
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([told])], ["x"])

assert {r.x for r in spark.range(4).mapInArrow(missing, "x string").collect()} == {"missing"}
from costlens.llm.queries import QUERIES
for name in names:
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows, name
    print("ran", name, len(rows))
"""


@pytest.mark.parametrize(
    "names",
    [
        ["op4_lm", "op8_urls", "op12_langid", "op13_fim"],
        ["op5_embeddings", "op6_quality", "op7_licenses", "op11_merkle"],
        ["op1_packing", "op3_bpe", "op9_simhash"],
    ],
)
def test_workers_need_no_copy(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    got = subprocess.run(
        [sys.executable, "-c", SCRIPT, REPO, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.count("ran ") == len(names)
