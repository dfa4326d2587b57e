"""Unit normalisation: the golden values, and what declines to compare."""

import pytest
from pyspark.sql import functions as F

from tillmark.functions import units

SCHEMA = "size_value double, size_unit string, pack_count int, is_capacity boolean, quantity double, unit_price double, line_total double, printed_unit string"


def norm(spark, *rows):
    df = spark.createDataFrame(list(rows), SCHEMA)
    n = units.normalize_line(*(F.col(c) for c in df.columns))
    return [r["n"] for r in df.select(n.alias("n")).collect()]


def test_weighed_line_is_assumed_pounds(spark):
    (r,) = norm(spark, (None, None, None, False, 0.52, 2.49, 1.29, None))
    assert (r["dimension"], r["base_unit"], r["basis"], r["inferred_unit"], r["display_unit"]) == ("weight", "g", "weighed", "lb", "lb")
    assert r["price_per_display"] == pytest.approx(2.49) and r["base_quantity"] == pytest.approx(0.52 * 453.59237)


def test_printed_kilograms_infer_nothing(spark):
    (r,) = norm(spark, (None, None, None, False, 0.5, 4.0, 2.0, "kg"))
    assert r["display_unit"] == "kg" and r["price_per_display"] == pytest.approx(4.0) and r["inferred_unit"] is None


@pytest.mark.parametrize(
    "row, unit, price",
    [
        ((10.0, "lb", None, False, 1.0, 6.99, 6.99, None), "lb", 0.699),
        ((14.0, "oz", None, False, 2.0, 5.99, 11.98, None), "lb", 11.98 / 28 * 16),
        ((12.0, "fl_oz", 6, False, 2.0, None, 14.40, None), "fl oz", 0.1),
        ((12.25, "oz", None, True, 1.0, 1.5, 1.5, None), "each", 1.5),
        ((None, None, None, False, 2.0, None, 3.0, None), "each", 1.5),
        ((500.0, "g", 0, False, 0.0, None, 5.0, None), "100g", 1.0),
    ],
)
def test_unit_items(spark, row, unit, price):
    (r,) = norm(spark, row)
    assert r["display_unit"] == unit and r["price_per_display"] == pytest.approx(price)


@pytest.mark.parametrize(
    "row, note",
    [
        ((15.0, "in", None, False, 1.0, None, 3.0, None), "size is a measurement ('in'), not an amount"),
        ((None, None, None, False, 1.0, None, None, None), "no package size and no line total"),
        ((1.0, "furlong", None, False, 1.0, None, 3.0, None), "unconvertible unit 'furlong'"),
        ((1.0, "lb", None, False, 1.0, None, None, None), "no line total to divide"),
        ((None, None, None, False, 0.5, None, None, None), "no unit price and no line total"),
        ((None, None, None, False, 0.5, 1.0, 1.0, "bunch"), "weighed in 'bunch', which is not a convertible unit"),
        ((None, None, None, True, 1.0, None, None, None), "size describes the object; no line total"),
    ],
)
def test_declined(spark, row, note):
    (r,) = norm(spark, row)
    assert r["price_per_base"] is None and r["note"] == note and r["display_unit"] is None


def test_capacity_note_and_null_size(spark):
    a, b = norm(spark, (12.25, "oz", None, True, 1.0, None, 1.5, None), (None, None, None, True, 1.0, None, 1.5, None))
    assert a["note"].startswith("12.25oz is the size") and b["price_per_base"] == 1.5


def test_short_numbers(spark):
    rows = spark.createDataFrame([(12.25,), (10.0,), (3785.411784,), (0.5,), (0.0,)], "x double")
    assert [r[0] for r in rows.select(units.short_number(F.col("x"))).collect()] == ["12.25", "10", "3785.41", "0.5", "0"]
