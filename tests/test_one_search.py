"""Jobs on several lanes search the texts once."""

import pytest

from ferrule.jobs import choices, lifecycle
from ferrule.operators import search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [choices.open_questions, lifecycle.lane_health, lifecycle.run_compare])
def test_texts_are_searched_once(spark, monkeypatch, query):
    calls, real = [], search.over_texts
    monkeypatch.setattr(search, "over_texts", lambda *a: calls.append(1) or real(*a))
    query(spark, SF)
    assert len(calls) == 1
