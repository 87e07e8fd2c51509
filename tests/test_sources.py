"""Shuffles against the platform's own, toy data sets, and the entry module without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest

from weftlist.sources import datasets

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("n", [0, 1, 2, 10, 97, 1000])
def test_shuffle(spark, n):
    jvm = spark._jvm
    items = jvm.java.util.ArrayList()
    for i in range(n):
        items.add(i)
    jvm.java.util.Collections.shuffle(items, jvm.java.util.Random(42))
    assert datasets.java_shuffle(n) == list(items)


def test_reshuffled(spark):
    rows = spark.createDataFrame([(i, "train" if i < 7 else "test") for i in range(10)], "ex_id long, split string")
    out = datasets.reshuffled(rows)
    order = datasets.java_shuffle(10)
    assert {r.ex_id: (r.place, r.split) for r in out.collect()} == {old: (new, "train" if new < 7 else "test") for new, old in enumerate(order)}
    assert datasets.reshuffled(rows, train=0.25).where("split = 'train'").count() == 2


def test_toy(spark):
    rows = datasets.load(spark, "/nowhere", "unary.all").collect()
    assert {r.dataset for r in rows if r.split == "test"} == {"colours"} and len({r.ex_id for r in rows}) == len(rows)
    assert datasets.toy(spark, "one").count() == 1
    with pytest.raises(ValueError):
        datasets.toy(spark, "none")


def test_without_training_data_operators(tmp_path):
    """The library, its entry and its queries hold together when the optional folders are deleted."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q) and len(q) > 60; import bench"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)  # only the folders are gone
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
