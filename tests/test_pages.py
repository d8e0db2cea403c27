"""Pages joined end to end are the whole order."""

import datetime as dt

import pytest

from talkmill.operators import browse

DAYS = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]


@pytest.mark.parametrize(("orders", "sort"), [(o, s) for o in (browse.HIT_SORTS, browse.BROWSE_SORTS) for s in o])
def test_pages_end_to_end(spark, orders, sort):
    rows = [(f"k{i:02}", [None, 0.5, 0.25, 0.5][i % 4], DAYS[i % 3], DAYS[i // 2 % 3], [None, "b", "a"][i // 3 % 3], i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "uuid string, score double, created_at timestamp, updated_at timestamp, name string, n_messages int").cache()
    fallback = next(iter(orders))
    want = [r.uuid for r in browse.sorted_page(df, orders, sort, fallback, "uuid", 100).collect()]
    got, cursor = [], None
    while page := browse.page_after(df, orders, sort, fallback, "uuid", 7, cursor).collect():
        got += [r.uuid for r in page]
        cursor = page[-1]
    assert got == want and len(got) == 24
