"""The entry module lists its queries without a session, and has SQL only for what it has."""

import re
import subprocess
import sys

from conftest import REPO


def test_names_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, timeout=120).returncode == 0


def test_nothing_else_imports_the_pipeline_package():
    import pathlib

    for p in pathlib.Path(REPO, "quire").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())
