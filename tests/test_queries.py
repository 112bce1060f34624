"""Every registered core query against its SQL, and that the optional subpackage is optional."""

import os
import subprocess
import sys

import pytest

from oracle import rows, views
from tarnline.plans.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        relation = con.execute(ORACLES[name])
        names = [d[0] for d in relation.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, relation.fetchall())
    else:
        assert got


def test_core_imports_without_the_optional_subpackage():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('tarnline.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert not [k for k in e.queries() if k[0] == 'p' and k[1].isdigit()]\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "contexts"]
