"""The registered catalogue: every query's SQL belongs to a query, and the flagship runs."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from navloom.plans import CATALOGUES

SF = "/root/testdata/sf0.001"


def test_catalogue_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert sum(len(c.queries) for c in CATALOGUES) >= 90


def test_the_rest_works_without_the_training_data_package(tmp_path):
    """As when its folders and the pipeline are deleted."""
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "navloom"), tmp_path / "navloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lookthrough_exposure' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_flagship(spark):
    assert entry.entry(spark).filter("exposure_inr > 0").count() > 0
