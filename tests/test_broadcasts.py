"""What is broadcast: bytes of files say little about the memory of a broadcast, measured rows do."""

from __future__ import annotations

import pytest

from threadline.operators import filters, state
from threadline.plans.derived_catalog import load_table
from threadline.session import GUESSED_BROADCAST, bound_broadcasts, write_stage

GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def plain(spark):
    """The session with the thresholds that Spark has by itself."""
    before = {k: spark.conf.get(k, None) for k in (GUESSED, MEASURED)}
    for key in before:
        spark.conf.unset(key)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ids_are_not_broadcast_because_their_files_are_small(plain):
    """A million ids lie in a file of a few MB and take some 70 MB in a broadcast."""
    ids = plain.range(1_000_000).selectExpr("id AS object_id", "id AS source_id", "id + 1 AS target_id")
    objects = write_stage(ids.coalesce(1), "ids")
    found = state.orphans(objects.where("object_id % 2 = 0"), objects)
    edges = filters.drop_isolated(objects.selectExpr("object_id AS id"), objects)
    for df in (found, edges):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0
    assert edges.count() == 1_000_000


def test_few_rows_are_still_broadcast(plain):
    left = write_stage(plain.range(100_000).coalesce(1), "left")
    few = write_stage(plain.range(10), "few")
    assert "BroadcastHashJoin" in left.join(few, "id", "left_semi")._jdf.queryExecution().executedPlan().toString()


def test_reading_a_derived_table_bounds_broadcasts(plain, data_dir):
    load_table(plain, data_dir, "objects")
    assert plain.conf.get(GUESSED) == str(GUESSED_BROADCAST)
    assert plain.conf.get(MEASURED) == str(10 * 1024 * 1024)


@pytest.mark.parametrize("own", ["-1", "1000"])
def test_a_session_keeps_a_lower_threshold(plain, own):
    plain.conf.set(GUESSED, own)
    bound_broadcasts(plain)
    assert plain.conf.get(GUESSED) == own
    assert plain.conf.get(MEASURED, None) is None
