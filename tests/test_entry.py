"""The entry points, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_a_ranking(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc_id", "rrf", "rank"]
    assert out.count() > 0


def test_sql_names_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "siltstone"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and 'pipeline' not in q; assert not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
