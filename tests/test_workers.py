import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from evigraph.session import build_session
spark = build_session("workers", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print("rows", entry.queries()["html_blocks"](spark, {data!r}).count(), entry.queries()["embed_text"](spark, {data!r}).count())
"""


def test_worker_code_needs_no_package_on_the_path(tmp_path, sf_dir):
    """Started elsewhere, Python workers get the functions with the job."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, data=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows" in done.stdout, done.stderr[-2000:]
