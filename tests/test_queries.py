"""Every registered statement gives what DuckDB gives on the same tables."""

import pytest
from compare import same

from tessera.framework_queries import FRAMEWORK
from tessera.queries import PAIRS, SAME
from tessera.session import prepare, register_tables, run_sql


@pytest.mark.parametrize("name", [*SAME, *PAIRS])
def test_statement(spark, duck, sf_dir, name):
    text, oracle = (SAME[name], SAME[name]) if name in SAME else PAIRS[name]
    prepare(spark)
    register_tables(spark, sf_dir)
    same(run_sql(spark, text), duck, oracle)


@pytest.mark.parametrize("name", FRAMEWORK)
def test_framework(spark, duck, sf_dir, name):
    query, oracle = FRAMEWORK[name]
    same(query(spark, sf_dir), duck, oracle)


@pytest.mark.parametrize("name, rows", [("integer_division", "SELECT count(*) FROM lineitem"), ("join_full", "SELECT count(*) FROM supplier FULL JOIN customer ON s_suppkey = c_custkey"), ("set_union_all", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"), ("json_more", "SELECT count(*) FROM events"), ("nulls_order", "SELECT count(*) FROM customer"), ("nulls_first", "SELECT count(*) FROM customer"), ("incremental_append", "SELECT 2 * count(*) FROM orders WHERE o_totalprice > 0")])
def test_statements_are_over_whole_tables(duck, name, rows):
    oracle = FRAMEWORK[name][1] if name in FRAMEWORK else SAME[name]
    assert duck.execute(f"SELECT count(*) FROM ({oracle})").fetchone() == duck.execute(rows).fetchone()
