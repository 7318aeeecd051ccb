"""Plan regression over every registered query (physical plans at sf0.001)."""

import pytest

from encore.plans.audit import audit, to_markdown

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    # Cached k-row rankings left by other tests would be substituted into identical plans.
    spark.catalog.clearCache()
    return {r["query"]: r for r in audit(spark, SF_SMALL)}


def test_every_query_reads_the_given_tables(rows):
    assert rows and all(r["scans"] >= 1 for r in rows.values())


def test_no_cartesian_products(rows):
    assert not [q for q, r in rows.items() if r["CartesianProduct"]]


def test_row_level_queries_have_no_single_partition(rows):
    for q in ["listening_sessions", "prepared_plays", "filter_date_range",
              "filter_artists", "filter_content_types", "filter_combined", "repeated_tracks", "records_nullfill"]:
        assert rows[q]["Exchange SinglePartition"] == 0, q


def test_sessions_gather_their_part_table_only(rows):
    for q in ["sessionize", "event_sessions"]:
        assert rows[q]["Exchange SinglePartition"] == 1, q


def test_kpis_expand_groups_not_the_log(spark):
    from encore.plans.registry import QUERIES

    plan = QUERIES["kpis"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    log = plan[plan.index("Exchange hashpartitioning(master_metadata"):] if "Expand" in plan else plan
    assert "Expand" not in log.split("FileScan")[0].split("Exchange hashpartitioning(master_metadata")[-1]


def test_rankings_with_a_uri_sort_no_log_rows(spark):
    from encore.plans.registry import QUERIES

    for q in ["featured_track", "enrich_tracks"]:
        plan = QUERIES[q](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            if "SortAggregate" in line:  # only over the plays of the k winners
                assert "_k_" in line, line


def test_rankings_are_top_k(rows):
    for q in ["top_artists_hours", "top_tracks_hours", "favorite_albums", "album_spotlight",
              "ranking_artists", "ranking_tracks", "ranking_albums", "platform_share"]:
        assert rows[q]["TakeOrderedAndProject"] == 1, q


def test_markdown_table(rows):
    md = to_markdown(list(rows.values()))
    assert md.count("\n") == len(rows) + 1
