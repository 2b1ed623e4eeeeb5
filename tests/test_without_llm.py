"""The library without its optional subpackage: left out, or emptied."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]

LIST = """
import json, __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(json.dumps([sorted(q), sorted(o)]))
"""

RUN = """
import __spark_entry__ as e
from soundalike.session import build_session
spark = build_session("local[2]", 2, **{"spark.ui.enabled": "false"})
print(e.queries()["b4_count"](spark, e.SMALL).count())
"""


def python(code: str, where: Path) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip().splitlines()[-1]


@pytest.mark.parametrize("state", ["gone", "emptied", "pipeline gone"])
def test_imports_and_runs(tmp_path, state):
    where = tmp_path / "copy"
    shutil.copytree(REPO, where, ignore=shutil.ignore_patterns(
        ".git", "__pycache__", "*.json", ".pytest_cache", *(["llm"] if state != "pipeline gone" else []),
        *(["corpus_pipeline.py"] if state == "pipeline gone" else [])))
    if state == "emptied":
        (where / "soundalike/llm").mkdir()
    queries, oracles = json.loads(python(LIST, where))
    others = [q for q in queries if not q.startswith("op")]
    assert len(others) >= 179 and "pipeline" not in queries and set(oracles) <= set(queries)
    assert any(q.startswith("op") for q in queries) == (state == "pipeline gone")
    if state == "gone":
        assert python(RUN, where) == "1"
