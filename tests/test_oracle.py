"""Every registered query against its DuckDB oracle on the driver tables."""

import pytest

from tests.conftest import SF001
from tests.oracle_check import compare, duck
from tendril.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)


SKEW_PATH = [
    "growth_timeline",
    "measurements_overview",
    "scd2_versions",
    "audit_rows",
    "events_plant_location",
    "plant_detail_images",
]


@pytest.mark.parametrize("name", SKEW_PATH)
def test_segmented_path_matches_oracle(spark, con, name):
    """Every key forced hot (split into time slices): results stay exact."""
    from tendril.operators.sequence import TARGET_ROWS_CONF

    spark.conf.set(TARGET_ROWS_CONF, "4")
    try:
        assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    finally:
        spark.conf.unset(TARGET_ROWS_CONF)


@pytest.mark.parametrize("name", ["plant_card_flags", "health_alerts", "growth_timeline", "upcoming_reminders"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
