"""Every registered query against its SQL twin on the smallest driver tables."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import ROOT, connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


#: the corpus operators have tests of their own
OWN = [name for name in entry.queries() if name not in entry.CORPUS_QUERIES]


def test_every_query_has_a_twin():
    assert set(OWN) == set(entry.oracle_sql()) - set(entry.CORPUS_TWINS)


def test_entry_imports_without_jars_or_session():
    code = "import os, pyspark; os.environ['SPARK_HOME'] = '/nowhere'; pyspark.__file__ = '/nowhere/__init__.py'; import __spark_entry__ as e; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_entry_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "catalogmatch"):
        source = os.path.join(ROOT, name)
        target = str(tmp_path / name)
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, target)
    code = "import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not e.CORPUS_QUERIES"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_twin(spark, duck, name):
    assert difference(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
