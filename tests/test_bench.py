import bench

from tsloom.plans import catalog


def test_headline_queries_are_registered_with_sql():
    assert set(bench.HEADLINE) <= set(catalog.QUERIES) & set(catalog.ORACLES)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and len(catalog.QUERIES) > 70
