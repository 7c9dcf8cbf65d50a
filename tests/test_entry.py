import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "kinlink", tmp_path / "kinlink", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_corpus_operators():
    own = [p for p in (ROOT / "kinlink").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "llm" in p.read_text()]


def test_sql_belongs_to_queries():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(x, str) for x in entry.oracle_sql().values()) and all(map(callable, entry.queries().values()))
