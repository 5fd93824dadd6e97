import re
import subprocess
import sys
from pathlib import Path

import pytest

from locusflow.llm import registry

from .oracle import same

SF = "/root/testdata/sf0.001"
TOP = Path(__file__).parents[2]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "labels", "conversations")}
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], **tables)


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in registry.queries()]
    assert sorted(numbers) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    for path in [*TOP.glob("*.py"), *(TOP / "locusflow").rglob("*.py"), *(TOP / "tests").glob("*.py")]:
        if "llm" not in path.parts and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert "llm" not in path.read_text(), path


def test_entry_lists_all():
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and 'op10_licenses' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, text=True, check=True).stdout) > 70
