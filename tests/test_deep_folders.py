from millrace.operators.profile import descendants


def test_folders_below_level_32(spark):
    rows = [(i, i - 1) for i in range(1, 41)] + [(1, 40)]
    found = descendants(spark.createDataFrame(rows, "folder_id bigint, parent_id bigint").coalesce(1), 0)
    assert sorted(tuple(r) for r in found.collect()) == [(i, i) for i in range(1, 41)]
