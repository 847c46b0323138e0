"""The entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["tsloom/llm", "tests/llm"], ["tsloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        where = copy / name
        shutil.rmtree(where, ignore_errors=True) if where.is_dir() else where.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and 'pipeline' not in q and not [n for n in q if n.startswith('op')], q; assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from tsloom import session

    class Conf:
        def get(self, key, default=None):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://there:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Fake())


def test_driver_gives_freed_memory_back(spark):
    from tsloom.session import trim

    assert "Trim native heap" in trim(spark)
