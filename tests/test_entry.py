import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 60


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """With specmint.llm and corpus_pipeline.py gone, the entry still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).resolve().parent
    shutil.copytree(root / "specmint", tmp_path / "specmint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 60 and 'pipeline' not in n and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
