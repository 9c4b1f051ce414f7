"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.queries import REGISTERED

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_imports_without_jars_or_session():
    """In a fresh process, with Spark's jar folder out of reach."""
    code = (
        "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
        "import __spark_entry__ as e; assert len(e.queries()) >= 74 and len(e.oracle_sql()) >= 71"
    )
    root = os.path.dirname(os.path.abspath(contract.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("missing", ["vitrina.llm", "corpus_pipeline", "zstandard", "xxhash", "vitrina.llm.queries"])
def test_entry_works_without_the_subpackage(missing):
    """In a fresh process that cannot import one of its modules or libraries."""
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries()) | set(e.oracle_sql())\n"
        "assert len(names) >= 78 and 'hybrid_search' in names, len(names)\n"
        "assert not [n for n in names if n.startswith('op') or n == 'pipeline'], names"
    )
    root = os.path.dirname(os.path.abspath(contract.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0
    assert out.columns == ["query_id", "id", "lex_rank", "vec_rank", "hybrid_score", "rank", "name", "image_path"]


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, connection, name):
    result = compare(spark, connection, name, SF_DIR)
    assert result.startswith(("ok", "rows only")), result
