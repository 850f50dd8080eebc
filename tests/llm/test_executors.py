"""Queries on executors that have Spark and the third-party libraries, but not this package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from factloom.session import session
spark = session(4, 4, **{{"spark.checkpoint.dir": "file://{tmp}/shared", "spark.sql.warehouse.dir": "{tmp}/warehouse"}})
def hidden(_):
    try:
        import factloom
    except ImportError:
        return ["hidden"]
    return ["seen"]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(hidden).collect() == ["hidden"]
import __spark_entry__
for name in {names!r}:
    __spark_entry__.queries()[name](spark, {data!r}).write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


@pytest.mark.parametrize("names", [["op2_vector_graph", "op3_bpe_roundtrip", "op4_toxicity", "op6_simhash", "op7_warc", "op8_pitman_yor_lm", "op9_exact_topk"], ["op11_winnowing", "op12_vector_codes", "op13_importance_resampling"], ["pipeline"]])
def test_workers_without_the_package(data, tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, tmp=tmp_path, names=names, data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == [x for n in names for x in ("done", n)]
