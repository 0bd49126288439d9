import pytest

from skein.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, same_rows):
    same_rows(registry.queries()[name](spark, sf_dir), SQL[name])


def test_queries_without_sql_are_tested_by_brute_force():
    from pathlib import Path

    tests = (Path(__file__).parent / "test_brute_force.py").read_text()
    for name in set(registry.queries()) - set(SQL):
        assert f'got("{name}")' in tests


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
