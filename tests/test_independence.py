"""The library works without its optional corpus folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_import_without_the_corpus_folder(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT / "siftwork", copy / "siftwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    script = "import __spark_entry__ as e; q = e.queries(); assert 'gate_verdict' in q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-B", "-c", script], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
