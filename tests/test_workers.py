"""Python operators must run where the package is not installed."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from assayer.catalogue import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("chunk_documents", "extract_html_text", "embed", "vector_search_batch", "vector_search_blocked"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("done")
"""


def test_package_is_not_needed_on_the_workers(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    result = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert result.stdout.strip().endswith("done"), result.stderr[-3000:]
