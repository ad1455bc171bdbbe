"""Each standing query against its SQL oracle, over whole tables."""

import oracle
import pytest

from tessera.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, con):
    oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_entry_knows_the_optional_part():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tessera"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tessera.llm" not in p.read_text() and "from .llm" not in p.read_text()
