"""The driver contract, also without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = """
import __spark_entry__ as e, sys
q = e.queries(); s = e.oracle_sql()
assert set(s) <= set(q) and len(q) > 100
print(sorted(k for k in q if k == 'pipeline' or k.startswith('op')))
print('FROM', *{m.__file__ for n, m in sys.modules.items() if n.split('.')[0] in ('tidemark', 'corpus_pipeline', '__spark_entry__')}, sep='|')
"""
#: The child finds modules in its folder alone.
ALONE = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}


def listed(folder, before=""):
    done = subprocess.run([sys.executable, "-c", before + SAY], cwd=folder, capture_output=True, text=True, timeout=120, env=ALONE)
    assert done.returncode == 0, done.stderr
    names, _, places = done.stdout.partition("FROM|")
    assert all(p.strip().startswith(str(folder)) for p in places.split("|"))
    return names


@pytest.mark.parametrize("without", [("tidemark/llm", "tests/llm"), ("tidemark/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_can_be_listed_without_the_optional_part(tmp_path, without):
    for name in ("tidemark", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (at := ROOT / name).is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path / name)
    for name in without:
        if (at := tmp_path / name).is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    names = listed(tmp_path)
    assert ("op1_" in names) == ("tidemark/llm" not in without and (ROOT / "tidemark/llm").is_dir())
    assert "pipeline" not in names


def test_a_missing_library_of_the_optional_part_loses_that_part_alone(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    assert "op1_" not in listed(tmp_path, "import sys\nsys.modules['zstandard'] = None\n")
