import os
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_rows(spark):
    df = e.entry(spark)
    assert df.columns == ["chromosome", "seg_start", "seg_end", "value"] and df.count() > 100


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_parts(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "runweave", ".git", "tests"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.makedirs(tmp_path / "runweave")
    for name in os.listdir(f"{ROOT}/runweave"):
        if name != "llm":
            os.symlink(f"{ROOT}/runweave/{name}", tmp_path / "runweave" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'coverage' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
