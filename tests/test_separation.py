"""The library without its optional parts, in a copy."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("subpackage", [True, False])
def test_entry_in_a_copy(tmp_path, subpackage, pipeline):
    left_out = shutil.ignore_patterns("__pycache__", *([] if subpackage else ["llm"]))
    shutil.copytree(ROOT / "defectlens", tmp_path / "defectlens", ignore=left_out)
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, tmp_path / name)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    total, operators, has_pipeline, checks_fit = run.stdout.split()
    there = subpackage and (ROOT / "defectlens" / "llm").exists()
    assert int(total) >= 192 and (int(operators) >= 10) == there and checks_fit == "True"
    assert (has_pipeline == "True") == (there and pipeline and (ROOT / "corpus_pipeline.py").exists())
