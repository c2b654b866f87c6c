"""The driver's contract."""

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_and_schemas(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert entry.entry(spark).columns == ["hash_part", "file_id"]


def test_core_queries_run(spark):
    for name in ("SC1_wanted_files", "F3_to_scan", "J1_bucket_links", "A10_index_counts", "G2_groups", "W9_move_plan", "N4_unique_folders", "D2f_capture_times"):
        assert entry.queries()[name](spark, DATA).count() >= 0
