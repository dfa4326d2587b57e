"""Self-consistency checks of receipts as column expressions over one aggregate of their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.scalars import format_cents, strip, to_cents
from tillmark.functions.units import short_number

PASS, FAIL, UNCHECKABLE = "pass", "fail", "uncheckable"
#: Cents that a product or a tax may be off; fixed value: flags of untaxed lines.
PENNY, UNTAXED = 1, ("N", "F", "O")
CHECKS = ("items_sum_to_subtotal", "subtotal_plus_tax_is_total", "tax_rate", "payment_reconciles", "item_count")


def line_aggregate(lines: DataFrame) -> DataFrame:
    """What the checks need of each receipt's charged lines."""
    charged = lines.filter(~F.coalesce(F.col("is_voided").cast("boolean"), F.lit(False)))
    cents = to_cents(F.col("line_total"))
    taxable = F.col("line_total").isNotNull() & ~F.upper(strip(F.coalesce("tax_flag", F.lit("")))).isin(*UNTAXED)
    return charged.groupBy("receipt_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("line_total").isNull().cast("int")).alias("n_missing"),
        F.array_sort(F.collect_list(F.when(F.col("line_total").isNull(), F.col("line_number")))).alias("missing"),
        F.sum(cents).alias("cents"),
        F.sum(taxable.cast("int")).alias("n_taxable"),
        F.sum(F.when(taxable, cents)).alias("taxable_cents"),
        F.sum(F.col("tax_flag").isNull().cast("int")).alias("n_unflagged"),
    )


def _verdict(uncheckable: Column, expected: Column, actual: Column, allowed: int, cents: bool = True) -> tuple[Column, Column, Column]:
    off = F.abs(expected - actual)
    none = F.lit(None).cast("bigint")
    status = F.when(uncheckable, UNCHECKABLE).when(off <= allowed, PASS).otherwise(FAIL)
    return status, F.when(~uncheckable, expected).otherwise(none) if cents else none, F.when(~uncheckable, actual).otherwise(none) if cents else none


def _text(*parts) -> Column:
    """Pieces joined; a string stands for itself."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def receipt_checks(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Five rows for each receipt: ``receipt_id, place, check_name, status, expected_cents, actual_cents, delta_cents, line_number, detail``.

    ``receipts`` has amounts in dollars as printed, ``lines`` the lines of all of them. A receipt
    without charged lines sums to 0.
    """
    r = receipts.join(line_aggregate(lines), "receipt_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sub, tax, total = (to_cents(F.col(c)) for c in ("subtotal", "tax", "total"))
    nil = lambda c: F.col(c).isNull()
    owed = F.rint(zero("taxable_cents") * F.col("tax_rate_percent") / 100).cast("bigint")
    rounding = zero(to_cents(F.col("rounding_adjustment")))
    paid = to_cents(F.col("amount_paid")) - total + rounding
    change = F.abs(to_cents(F.col("change_given")))
    verdicts = (
        _verdict(nil("subtotal") | (zero("n_missing") > 0), sub, zero("cents"), 0),
        _verdict(nil("subtotal") | nil("total"), sub + zero(tax), total, 0),
        _verdict(nil("tax_rate_percent") | nil("tax") | (zero("n_taxable") == 0) | (zero("n_unflagged") > 0), owed, tax, PENNY),
        _verdict(nil("amount_paid") | nil("change_given") | nil("total"), paid, change, 0),
        _verdict(nil("item_count_printed"), F.col("item_count_printed").cast("bigint"), zero("n"), 0, cents=False),
    )
    money = format_cents
    sums = _text(zero("n"), " items sum to ", money(zero("cents")))
    parts = _text(money(sub), " + ", money(zero(tax)), " = ")
    rate = _text(zero("n_taxable"), " taxable items = ", money(zero("taxable_cents")), " x ", short_number(F.col("tax_rate_percent")), "% = ")
    given = _text("paid ", money(to_cents(F.col("amount_paid"))), " - total ", money(total), F.when(rounding != 0, _text(" (+", money(rounding), " rounding)")).otherwise(""), " = ")
    missing = F.concat(F.lit("["), F.array_join(F.transform("missing", lambda x: x.cast("string")), ", "), F.lit("]"))
    # fixed values: what a page says of a check that cannot run, that agrees, that does not
    said = (
        (F.when(nil("subtotal"), "no subtotal printed").otherwise(_text("line(s) ", missing, " have no amount, so no sum is possible")), sums, _text(sums, " but the printed subtotal is ", money(sub), " (off by ", money(F.abs(zero("cents") - sub)), ")")),
        (F.lit("subtotal or total not printed"), _text(parts, money(total)), _text(parts, money(sub + zero(tax)), " but the printed total is ", money(total))),
        (
            F.when(nil("tax_rate_percent"), "no tax rate printed").when(nil("tax"), "no tax amount printed").when(zero("n_taxable") == 0, "no line items are flagged taxable").otherwise("some lines have no tax flag printed"),
            _text(rate, money(tax)),
            _text(rate, money(owed), " but the printed tax is ", money(tax), " -- a tax flag or an amount is misread"),
        ),
        (F.when(nil("amount_paid") | nil("change_given"), "payment or change not printed").otherwise("no total printed"), _text(given, "change ", money(change)), _text(given, money(paid), " but the printed change is ", money(change))),
        (F.lit("no item count printed"), _text("extracted ", zero("n"), " items, receipt says ", F.col("item_count_printed")), _text("extracted ", zero("n"), " items but the receipt says ", F.col("item_count_printed"), " -- a line was dropped or invented")),
    )
    rows = []
    for k, (name, (status, expected, actual), (why, good, bad)) in enumerate(zip(CHECKS, verdicts, said, strict=True)):
        detail = F.when(status == UNCHECKABLE, why).when(status == PASS, good).otherwise(bad)
        rows.append(F.struct(F.lit(k).alias("place"), F.lit(name).alias("check_name"), status.alias("status"), expected.cast("bigint").alias("expected_cents"), actual.cast("bigint").alias("actual_cents"), detail.alias("detail")))
    out = r.select("receipt_id", F.inline(F.array(*rows)))
    return out.select("receipt_id", "place", "check_name", "status", "expected_cents", "actual_cents", (F.col("actual_cents") - F.col("expected_cents")).alias("delta_cents"), F.lit(None).cast("int").alias("line_number"), "detail")


def line_checks(lines: DataFrame) -> DataFrame:
    """One row for each charged line with quantity, unit price and total: their product within a cent of the total."""
    some = lines.filter(~F.coalesce(F.col("is_voided").cast("boolean"), F.lit(False)) & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("line_total").isNotNull())
    expected = F.rint(F.col("quantity") * F.col("unit_price") * 100).cast("bigint")
    actual = to_cents(F.col("line_total"))
    status = F.when(F.abs(expected - actual) <= PENNY, PASS).otherwise(FAIL)
    name = F.substring(F.coalesce("raw_description", F.lit("")), 1, 24) if "raw_description" in lines.columns else F.lit("")
    head = _text("line ", F.col("line_number"), " (", name, "): ", short_number(F.col("quantity")), " x ", F.format_string("%.2f", F.col("unit_price")), " = ")
    detail = F.when(status == PASS, _text(head, format_cents(actual))).otherwise(_text(head, format_cents(expected), " but the line total printed is ", format_cents(actual)))
    return some.select(
        "receipt_id", F.lit(len(CHECKS)).alias("place"), F.lit("line_arithmetic").alias("check_name"), status.alias("status"),
        expected.alias("expected_cents"), actual.alias("actual_cents"), (actual - expected).alias("delta_cents"), "line_number", detail.alias("detail"),
    )


def validate(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """All checks of all receipts; ``place`` and ``line_number`` sort a report."""
    return reduce(DataFrame.unionByName, (receipt_checks(receipts, lines), line_checks(lines)))


def report(checks: DataFrame) -> DataFrame:
    """Each receipt's verdicts: failed, passed, uncheckable, evidence, and whether nothing failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = checks.groupBy("receipt_id").agg(n(PASS).alias("passed"), n(FAIL).alias("failed"), n(UNCHECKABLE).alias("uncheckable"))
    ran = F.col("passed") + F.col("failed")
    head = F.when(F.col("failed") == 0, "TRUSTWORTHY").otherwise("NEEDS REVIEW")
    text = F.concat(head, F.lit(": "), F.col("passed").cast("string"), F.lit("/"), ran.cast("string"), F.lit(" checks passed"), F.when(F.col("uncheckable") > 0, F.concat(F.lit(", "), F.col("uncheckable").cast("string"), F.lit(" not printed"))).otherwise(""))
    return out.withColumns({"evidence": ran, "trustworthy": F.col("failed") == 0, "summary": F.when(ran == 0, "no checks could run -- this receipt proves nothing about itself").otherwise(text)})


def preview(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """The console's looser rule: sums of what amounts there are against the subtotal, within a cent as floats."""
    s = lines.filter(~F.coalesce(F.col("is_voided").cast("boolean"), F.lit(False))).groupBy("receipt_id").agg(F.coalesce(F.sum("line_total"), F.lit(0.0)).alias("summed"))
    out = receipts.select("receipt_id", "subtotal").join(s, "receipt_id", "left").withColumn("summed", F.coalesce("summed", F.lit(0.0)))
    return out.withColumn("agrees", F.abs(F.col("summed") - F.col("subtotal")) < 0.01)
