"""Histories, changes, stores, spend and hints on hand-made shoppers."""

import pytest

from tillmark.operators import analysis as an
from tillmark.operators import pages

R = "receipt_id long, shopper_id long, purchase_date string, merchant_name string, total_cents long"
L = "line_item_id long, receipt_id long, line_number int, product_id string, line_total_cents long, price_per_display double, display_unit string, inferred_unit string, is_voided int"
P = "product_id string, canonical_text string, category string"


def tables(spark, receipts, lines, products=(("p1", "onion", "produce"), ("p2", "milk", "dairy"))):
    rows = [(k, r, k, p, c, price, "lb", None, void) for k, (r, p, c, price, void) in enumerate(lines)]
    return spark.createDataFrame(list(receipts), R), spark.createDataFrame(rows, L), spark.createDataFrame(list(products), P)


def history(spark, *visits):
    r, li, p = tables(spark, [(k, 1, d, s, 100) for k, (d, s, _) in enumerate(visits)], [(k, "p1", 100, price, 0) for k, (_, _, price) in enumerate(visits)])
    points = an.price_points(li, r, p)
    return an.histories(points).collect(), an.store_comparison(points).collect()


@pytest.mark.parametrize(
    "visits, change",
    [
        ([("2026-01-01", "a", 2.49), ("2026-01-01", "a", 2.49)], None),
        ([("2026-01-01", "a", 2.0), ("2026-01-02", "a", 2.5)], 25.0),
        ([("2026-01-01", "a", 2.0), ("2026-01-02", "a", 1.5)], -25.0),
        ([("2026-01-01", "a", 0.0), ("2026-01-02", "a", 1.5)], None),
        ([(None, "a", 1.0), ("2026-01-02", "a", 1.5)], None),
    ],
)
def test_change(spark, visits, change):
    (h,), _ = history(spark, *visits)
    assert h["change_percent"] == change and h["times_bought"] == 2


def test_extremes_keep_the_first_on_ties(spark):
    (h,), _ = history(spark, ("2026-01-02", "b", 2.0), ("2026-01-01", "a", 2.0), ("2026-01-03", "c", 2.0))
    assert (h["cheapest_store"], h["dearest_store"], h["latest_store"], h["stores"]) == ("a", "a", "c", ["a", "b", "c"])


def test_two_stores(spark):
    _, (s,) = history(spark, ("2026-01-01", "a", 2.0), ("2026-01-02", "b", 3.0), ("2026-01-03", None, 9.0))
    assert (s["cheapest_store"], s["dearest_store"], s["gap_percent"]) == ("a", "b", 50.0)
    assert history(spark, ("2026-01-01", "a", 2.0), ("2026-01-02", "", 3.0))[1] == []


def test_free_in_one_store_has_no_gap(spark):
    _, (s,) = history(spark, ("2026-01-01", "a", 0.0), ("2026-01-02", "b", 3.0))
    assert s["gap_percent"] is None


def test_spend_shares_and_unsorted(spark):
    r, li, p = tables(spark, [(1, 1, "2026-01-01", "a", 1000), (2, 2, "2026-01-01", "a", 5)], [(1, "p1", 600, None, 0), (1, None, 300, None, 0), (1, "p3", 100, None, 0), (1, "p1", 900, None, 1), (2, "p1", 5, None, 0)], (("p1", "onion", "produce"), ("p3", "x", "unsorted")))
    got = sorted((x["shopper_id"], x["category"], x["cents"], x["share"]) for x in an.spend_by_category(li, r, p).collect())
    assert got == [(1, "produce", 600, 60.0), (1, "unsorted", 100, 10.0), (1, "unsorted", 300, 30.0), (2, "produce", 5, 100.0)]


def test_visits_without_lines_stay(spark):
    r, li, p = tables(spark, [(1, 1, "2026-01-01", "a", None), (2, 1, None, "b", 250)], [(1, "p1", 1, 1.0, 1)])
    assert sorted((x["receipt_id"], x["spent"], x["items"]) for x in an.spend_over_time(r, li).collect()) == [(1, 0.0, 0), (2, 2.5, 0)]
    assert sorted((x["receipt_id"], x["items"]) for x in pages.dashboard_receipts(r, li).collect()) == [(1, 1), (2, 0)]


def test_summary_and_hints_of_an_empty_account(spark):
    r, li, p = tables(spark, [(1, 1, "2026-01-01", "a", 500)], [(1, "p1", 500, 1.0, 0)])
    who = spark.createDataFrame([(1,), (2,)], "shopper_id long")
    points = an.price_points(li, r, p)
    s = {x["shopper_id"]: x for x in an.summary(who, r, an.histories(points)).collect()}
    assert (s[1]["shops"], s[1]["total_spent"], s[2]["shops"], s[2]["average_shop"], s[2]["average_change"]) == (1, 5.0, 0, 0.0, None)
    hints = {}
    for x in an.unlock_hints(who, r, points).collect():
        hints.setdefault(x["shopper_id"], []).append((x["rank"], x["needs"]))
    assert [k for k, _ in sorted(hints[2])] == [1, 3, 4, 5] and sorted(hints[2])[0][1] == "Buy something again on a different day"
    assert [k for k, _ in sorted(hints[1])] == [1, 2, 3, 4, 5] and sorted(hints[1])[4][1].endswith("(best so far: 1)")


def test_nested_points_are_in_order(spark):
    r, li, p = tables(spark, [(2, 1, "2026-01-01", "b", 1), (1, 1, "2026-01-02", "a", 1)], [(1, "p1", 1, 3.0, 0), (2, "p1", 1, 2.0, 0)])
    (h,) = an.nested_histories(an.price_points(li, r, p)).collect()
    assert [x["price"] for x in h["points"]] == [2.0, 3.0]


def test_page_totals_of_empty_tables(spark):
    checks = spark.createDataFrame([], "receipt_id long, status string")
    (t,) = pages.check_totals(checks).collect()
    assert t["pass"] is None and t["ran"] == 0 and t["pass_rate"] is None
    aliases = spark.createDataFrame([("A", "x", 1), ("A", "y", 0)], "store string, raw_description string, needs_review int")
    assert [x["raw_description"] for x in pages.worklist(aliases).collect()] == ["x"]
    assert pages.parse_rate(aliases).head()["rate"] == 50.0
