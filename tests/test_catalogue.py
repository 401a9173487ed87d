import pytest

from embspark.operators import layout
from embspark.plans.catalogue import QUERIES, SQL
from tests.conftest import DATA
from tests.oracle import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    d = f"{DATA}/sf0.01"
    compare(QUERIES[name](spark, d), d, SQL[name])


def test_peephole_groups_end_at_five_clean_pages(spark):
    pages = [(1, 32, p) for p in (0, 1, 6, 12, 13, 18, 30)] + [(1, 64, 7), (2, 32, 2)]
    got = layout.peephole_groups(spark.createDataFrame(pages, "generation long, dim int, page long")).collect()
    assert sorted(map(tuple, got)) == [(1, 32, 0, 6, 3), (1, 32, 12, 18, 3), (1, 32, 30, 30, 1), (1, 64, 7, 7, 1), (2, 32, 2, 2, 1)]


def test_peephole_query_has_all_dirty_pages(spark):
    d = f"{DATA}/sf0.01"
    pages = sum(r["n_pages"] for r in QUERIES["q14_dirty_pages"](spark, d).collect())
    assert sum(r["n_pages"] for r in QUERIES["q16b_peephole_all"](spark, d).collect()) == pages
