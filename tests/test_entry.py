"""The entry module works without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_text_operators(tmp_path):
    for name in ("tramline", "__spark_entry__.py", "corpus_pipeline.py"):
        path = os.path.join(ROOT, name)
        if os.path.isdir(path):
            shutil.copytree(path, tmp_path / name, ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
        elif os.path.exists(path):
            shutil.copy(path, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
