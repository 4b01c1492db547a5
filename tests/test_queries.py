import pytest

from lodestone.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    got, want = compare(spark, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_queries_without_sql(spark):
    """What SQL can't express here; each has tests of its own against brute force."""
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"ann_leg_top50", "ann_recall", "stemmed_leg"}
    for name in without:
        assert registry.queries()[name](spark, SF).limit(1).count() == 1
