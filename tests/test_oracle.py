"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import difference, duck_rows, spark_rows

import checks


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(name, spark, duck, data_dir):
    result = spark_rows(checks.QUERIES[name](spark, data_dir))
    if name in checks.ORACLE:
        assert difference(result, duck_rows(duck, checks.ORACLE[name])) == ""
    else:
        assert sum(result[1].values()) > 0


def test_every_oracle_has_a_query():
    assert set(checks.ORACLE) <= set(checks.QUERIES)


def test_derived_catalog_has_the_intended_variety(duck):
    from threadline.plans.derived_catalog import ctes

    def one(tables, sql):
        return duck.execute(ctes(*tables) + " " + sql).fetchone()[0]

    assert one(["objects"], "SELECT count(*) - count(DISTINCT object_id) FROM objects") == 0
    assert one(["lineage_edges"], "SELECT count(*) - count(DISTINCT (source_id, target_id)) FROM lineage_edges") == 0
    assert one(["dependencies"], "SELECT count(*) FROM dependencies WHERE referenced_object_id IS NULL") > 0
    hub = one(["lineage_edges"], "SELECT max(n) FROM (SELECT count(*) AS n FROM lineage_edges WHERE source_id % 10 = 6 GROUP BY source_id)")
    orders = duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert hub > orders / 10
