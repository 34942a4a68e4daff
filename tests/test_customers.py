"""Lookups in bulk and the name search."""

import random
import re
from datetime import date
from decimal import Decimal

import pytest

from memberlens.params import InvalidParameter
from memberlens.plans import compose, customers
from memberlens.schemas import TABLES
from memberlens.sources.warehouse import FrameWarehouse


@pytest.fixture
def wh(spark):
    def build(**given):
        frames = {}
        for name in ("customers", "renewals", "upgrade_offers", "membership_history", "customer_tiers"):
            schema = TABLES[name]
            rows = [
                tuple(
                    Decimal(str(row[f.name]))
                    if f.dataType.typeName() == "decimal" and row.get(f.name) is not None
                    else row.get(f.name)
                    for f in schema.fields
                )
                for row in given.get(name, [])
            ]
            frames[name] = spark.createDataFrame(rows, schema)
        return FrameWarehouse(spark, frames)

    return build


def person(i, first, last, **more):
    return {"customer_id": i, "first_name": first, "last_name": last, **more}


def found(frame):
    return {r["customer_id"]: r.asDict() for r in frame.collect()}


def test_profile_fills_numbers_and_flags_only_when_found(spark, wh):
    warehouse = wh(customers=[person(1, "Ann", "Lee", lifetime_spend=12.5, join_date=date(2024, 1, 2))])
    got = found(customers.customer_profiles(warehouse, customers.customer_ids(spark, [1, 7])))
    assert len(got[1]) == 20
    assert got[1]["found"] and got[1]["lifetime_spend"] == 12.5 and got[1]["total_visits"] == 0
    assert got[1]["is_active"] is False and got[1]["email"] is None
    assert got[7]["found"] is False
    assert all(v is None for k, v in got[7].items() if k not in ("customer_id", "found"))


def test_latest_renewal_is_picked(spark, wh):
    def renewal(i, on, likelihood):
        return {"renewal_id": i, "customer_id": 1, "renewal_date": on, "renewal_likelihood": likelihood}

    warehouse = wh(renewals=[
        renewal(1, date(2024, 1, 1), "Moderate"), renewal(3, date(2024, 6, 1), "Unlikely"),
        renewal(2, date(2024, 6, 1), "At Risk"), renewal(9, None, "Very Likely"),
    ])
    got = found(customers.customer_renewals(warehouse, customers.customer_ids(spark, [1, 2])))
    assert got[1]["renewal_id"] == 3 and got[1]["renewal_likelihood"] == "Unlikely"
    assert not got[2]["found"]


def test_activity_is_newest_first_limited_and_keeps_nulls(spark, wh):
    history = [
        {"event_id": e, "customer_id": c, "event_date": date(2024, 1, d), "event_type": "Renewal",
         "campaign_id": 4 if e == 6 else None}
        for e, c, d in [(1, 1, 1), (2, 1, 9), (3, 1, 3), (4, 1, 9), (5, 1, 5), (6, 1, 2), (7, 1, 8), (8, 2, 1)]
    ]
    warehouse = wh(membership_history=history)
    ids = customers.customer_ids(spark, [1])
    events = [r["event_id"] for r in customers.recent_activity(warehouse, ids).collect()]
    assert events == [4, 2, 7, 5, 3]
    rows = customers.recent_activity(warehouse, ids, 20).collect()
    assert len(rows) == 7
    assert {r["event_id"]: r["campaign_id"] for r in rows}[6] == 4
    assert all(r["from_tier"] is None and r["campaign_id"] is None for r in rows if r["event_id"] != 6)
    for limit in (0, 21):
        with pytest.raises(InvalidParameter):
            customers.recent_activity(warehouse, ids, limit)


def test_offer_and_health_of_unknown_ids(spark, wh):
    warehouse = wh(
        upgrade_offers=[person(1, "A", "B", recommended_tier="Gold")],
        customer_tiers=[person(1, "A", "B", ai_tier="Silver", churn_probability_pct=95)],
    )
    ids = customers.customer_ids(spark, [1, 2])
    assert found(customers.upgrade_offers(warehouse, ids))[1]["recommended_tier"] == "Gold"
    health = found(customers.customer_health(warehouse, ids))
    assert health[1]["churn_probability_pct"] == 95.0 and health[1]["predicted_ltv_12m"] == 0.0
    assert not health[2]["found"]


def test_customer_360_has_one_row_per_id(spark, wh):
    warehouse = wh(
        customers=[person(1, "A", "B")],
        membership_history=[
            {"event_id": e, "customer_id": 1, "event_date": date(2024, 1, 1), "event_type": "Signup"}
            for e in range(8)
        ],
    )
    got = found(compose.customer_360(warehouse, customers.customer_ids(spark, [1, 1, 5])))
    assert [e["event_id"] for e in got[1]["recent_activity"]] == [7, 6, 5, 4, 3]
    assert got[5]["recent_activity"] is None and not got[5]["has_renewal"]


def like(pattern):
    parts = [".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{pattern.lower()}%"]
    return re.compile("".join(parts), re.DOTALL)


def test_name_search_equals_testing_every_pair(spark, wh):
    rnd = random.Random(5)
    firsts = ["Ann", "anna", "Ka%l", "Li_a", "Zoë", "A\\b", "Charlotte"]
    lasts = ["Williams", "Wilson", "O'Neil", "Lee", "Li", "Ångström"]
    people = [
        (i, rnd.choice(firsts), rnd.choice(lasts) + rnd.choice(["", "son"])) for i in range(1, 160)
    ]
    queries = ["charlotte w", "WIL", "a", "n l", "%", "_", "___________________", "a%s", "a_n", "zoë",
               "\\", "A\\B", "A", "a", "WIL", "ka%l", "å", "lee son", "nobody", "ill%ms", "%%", "e w_l"]
    warehouse = wh(customers=[person(*p) for p in people] + [person(500, None, "Lee")])
    hits = customers.search_customers(warehouse, customers.name_queries(spark, queries)).collect()
    want = []
    for number, query in enumerate(queries, start=1):
        matches = [i for i, f, l in people if like(query).fullmatch(f"{f} {l}".lower())]
        want += [(number, i) for i in sorted(matches)[:20]]
    assert sorted((h["query_id"], h["customer_id"]) for h in hits) == want
    assert len(hits[0]) == 20


def test_search_and_ids_are_checked(spark):
    for bad in ([""], [None]):
        with pytest.raises(InvalidParameter):
            customers.name_queries(spark, bad)
    for bad in ([0], [-1], [1.5], [True], ["1"]):
        with pytest.raises(InvalidParameter):
            customers.customer_ids(spark, bad)


def test_no_pair_join_in_the_search_plan(spark, wh, capsys):
    warehouse = wh(customers=[person(1, "A", "B")])
    plan = customers.search_customers(warehouse, customers.name_queries(spark, ["ab"]))
    capsys.readouterr()
    plan.explain()
    text = capsys.readouterr().out
    assert "NestedLoop" not in text and "Cartesian" not in text and "WindowGroupLimit" in text
