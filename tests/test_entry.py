import __spark_entry__ as entry


def test_registry_is_consistent(spark):
    assert len(entry.queries()) > 90 and set(entry.oracle_sql()) <= set(entry.queries())
