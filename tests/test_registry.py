import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from lodestack.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
def test_queries_against_sql(spark):
    names = list(registry.queries())
    assert set(registry.oracle_sql()) == set(names)
    assert compare.compare(spark, names, SF) == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
