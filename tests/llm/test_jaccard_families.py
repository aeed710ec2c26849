"""Large groups of near copies in the grouped prefix join, against brute force."""

import pytest
from test_setsketch_dedup import brute, families

from urlsift.llm import jaccard_groupjoin, setsketch_dedup


@pytest.mark.parametrize(("groups", "copies", "length", "most"), [(4, 60, 120, 5), (1, 500, 150, 7)])
def test_families_of_near_copies(spark, monkeypatch, groups, copies, length, most):
    monkeypatch.setattr(setsketch_dedup, "BLOCK", 41)  # several blocks a family
    monkeypatch.setattr(jaccard_groupjoin, "PARTNER_BLOCK", 50)
    rows = list(enumerate(families(groups, groups, copies, length, most)))
    got = jaccard_groupjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == sorted(r[:3] for r in brute(rows, 90))
