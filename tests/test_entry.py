"""The entry file without the parts that can be left out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(e.llm, e.corpus_pipeline, 'gap_matrix' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "evigraph"), tmp_path / "evigraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.stdout.split() == ["None", "None", "True", "False", "True"], done.stderr
