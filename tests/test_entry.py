"""The driver's contract."""

import os
import subprocess
import sys

import __spark_entry__ as entry_module
from helpers import near

ROOT = os.path.dirname(os.path.abspath(entry_module.__file__))


def test_entry(spark):
    made = entry_module.entry(spark)
    assert made.columns == ["t", "n_leaves", "n_risk", "sf", "sf_var"]
    first = made.orderBy("t").first()
    assert near([first["sf"]], [1.0])


def test_names():
    known, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(known)
    assert all(callable(f) for f in known.values())


def copy_without(tmp_path, *left_out):
    for name in os.listdir(ROOT):
        if name not in ("framewalk", "tests", ".git", ".pytest_cache", *left_out):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    for top in ("framewalk", "tests"):
        os.mkdir(tmp_path / top)
        for name in os.listdir(f"{ROOT}/{top}"):
            if name not in ("llm", "__pycache__"):
                os.symlink(f"{ROOT}/{top}/{name}", tmp_path / top / name)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    return os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(tmp_path), os.environ.get("PYTHONPATH")]))}


def test_without_the_pipeline_folders(tmp_path):
    """The rest is imported, its tests are collected, and those of the state sequences pass when the llm subpackage and the pipeline are not there."""
    env = copy_without(tmp_path, "corpus_pipeline.py")
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') or k == 'pipeline' for k in e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["False"], said.stderr
    pytest_ = [sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    every = subprocess.run([*pytest_, "--collect-only", "tests"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert every.returncode == 0, every.stdout[-2000:]
    some = subprocess.run([*pytest_, "tests/test_states.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert some.returncode == 0, some.stdout[-2000:]


def test_a_broken_pipeline_is_not_hidden(tmp_path):
    env = copy_without(tmp_path, "corpus_pipeline.py")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "no_such_module" in said.stderr
