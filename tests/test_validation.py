"""Checks of receipts on the reference basket and its edge cases."""

from tillmark.operators import validation

LINE = "receipt_id long, line_number int, line_total double, quantity double, unit_price double, tax_flag string, is_voided boolean"
RECEIPT = "receipt_id long, subtotal double, tax double, total double, tax_rate_percent double, amount_paid double, change_given double, rounding_adjustment double, item_count_printed int"
TOTALS = (4.97, 5.0, 3.98, 6.06, 2.98, 5.0, 4.0, 5.02, 4.79)
FLAGS = "XXNXNXTTX"


def run(spark, receipt, lines):
    r = spark.createDataFrame([(1, *receipt)], RECEIPT)
    x = spark.createDataFrame([(1, *row) for row in lines], LINE)
    out = {}
    for c in validation.validate(r, x).collect():
        out.setdefault(c["check_name"], []).append((c["status"], c["expected_cents"], c["actual_cents"]))
    return out


def plain(*totals, **kw):
    return [(k + 1, t, None, None, "X", False) for k, t in enumerate(totals)]


def amounts(subtotal=None, tax=None, total=None, rate=None, paid=None, change=None, rounding=None, count=None):
    return (subtotal, tax, total, rate, paid, change, rounding, count)


def test_sum_ignores_voided_lines(spark):
    lines = [*plain(1.0, 2.0), (3, 9.0, None, None, None, True)]
    assert run(spark, amounts(subtotal=3.0), lines)["items_sum_to_subtotal"] == [("pass", 300, 300)]


def test_sum_is_exact_and_null_is_uncheckable(spark):
    assert run(spark, amounts(subtotal=3.01), plain(1.0, 2.0))["items_sum_to_subtotal"][0][0] == "fail"
    assert run(spark, amounts(subtotal=3.0), plain(1.0, None))["items_sum_to_subtotal"][0][0] == "uncheckable"
    assert run(spark, amounts(), plain(1.0))["items_sum_to_subtotal"][0][0] == "uncheckable"


def test_absent_tax_is_zero_in_the_total(spark):
    assert run(spark, amounts(subtotal=3.0, total=3.0), plain(3.0))["subtotal_plus_tax_is_total"] == [("pass", 300, 300)]


def test_line_arithmetic_allows_a_penny(spark):
    lines = [(1, 1.29, 0.52, 2.49, "N", False), (2, 1.32, 0.52, 2.49, "N", False), (3, None, 1.0, 1.0, "N", False)]
    assert [s for s, *_ in run(spark, amounts(), lines)["line_arithmetic"]] == ["pass", "fail"]


def test_tax_basket(spark):
    lines = [(k + 1, t, None, None, f, False) for k, (t, f) in enumerate(zip(TOTALS, FLAGS, strict=True))]
    total = sum(round(t * 100) for t, f in zip(TOTALS, FLAGS, strict=True) if f != "N")
    expected = round(total * 6.35 / 100)
    assert run(spark, amounts(tax=expected / 100, rate=6.35), lines)["tax_rate"] == [("pass", expected, expected)]
    assert run(spark, amounts(tax=expected / 100 + 0.02, rate=6.35), lines)["tax_rate"][0][0] == "fail"
    assert run(spark, amounts(tax=1.97, rate=6.35), [*lines, (10, 1.0, None, None, None, False)])["tax_rate"][0][0] == "uncheckable"
    assert run(spark, amounts(tax=1.97, rate=6.35), [(1, 1.0, None, None, " n ", False)])["tax_rate"][0][0] == "uncheckable"


def test_payment_by_magnitude_with_rounding(spark):
    assert run(spark, amounts(total=43.77, paid=60.0, change=16.25, rounding=0.02), plain(1.0))["payment_reconciles"] == [("pass", 1625, 1625)]
    assert run(spark, amounts(total=7.23, paid=10.0, change=-2.77), plain(1.0))["payment_reconciles"][0][0] == "pass"


def test_count_and_report(spark):
    assert run(spark, amounts(count=2), plain(1.0, 1.0))["item_count"] == [("pass", None, None)]
    r = spark.createDataFrame([(1, *amounts(subtotal=3.0, count=5)), (2, *amounts())], RECEIPT)
    x = spark.createDataFrame([(1, *row) for row in plain(1.0, 2.0)], LINE)
    got = {c["receipt_id"]: c for c in validation.report(validation.validate(r, x)).collect()}
    assert got[1]["summary"] == "NEEDS REVIEW: 1/2 checks passed, 3 not printed" and not got[1]["trustworthy"]
    assert got[2]["evidence"] == 0 and got[2]["summary"].startswith("no checks could run")


def test_details_say_what_was_compared(spark):
    lines = [(1, 1.29, 0.52, 2.49, "N", False), (2, 5.0, 2.0, 2.0, "X", False)]
    r = spark.createDataFrame([(1, *amounts(subtotal=6.29, tax=0.32, total=6.61, rate=6.35, paid=60.0, change=53.37, rounding=-0.02, count=3))], RECEIPT)
    x = spark.createDataFrame([(1, *row) for row in lines], LINE)
    got = {(c["check_name"], c["line_number"]): c["detail"] for c in validation.validate(r, x).collect()}
    assert got["items_sum_to_subtotal", None] == "2 items sum to 6.29"
    assert got["subtotal_plus_tax_is_total", None] == "6.29 + 0.32 = 6.61"
    assert got["tax_rate", None] == "1 taxable items = 5.00 x 6.35% = 0.32"
    assert got["payment_reconciles", None] == "paid 60.00 - total 6.61 (+-0.02 rounding) = change 53.37"
    assert got["item_count", None] == "extracted 2 items but the receipt says 3 -- a line was dropped or invented"
    assert got["line_arithmetic", 1] == "line 1 (): 0.52 x 2.49 = 1.29"
    assert got["line_arithmetic", 2] == "line 2 (): 2 x 2.00 = 4.00 but the line total printed is 5.00"
    r = spark.createDataFrame([(1, *amounts(subtotal=6.29))], RECEIPT)
    x = spark.createDataFrame([(1, 5, None, None, None, "N", False), (1, 2, None, None, None, "N", False)], LINE)
    got = {c["check_name"]: c["detail"] for c in validation.validate(r, x).collect()}
    assert got["items_sum_to_subtotal"] == "line(s) [2, 5] have no amount, so no sum is possible" and got["tax_rate"] == "no tax rate printed"
