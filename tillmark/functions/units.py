"""Unit normalisation: what a line bought, and its price in a unit that compares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit, dimension, base units in one of it.
UNITS = (
    ("g", "weight", 1.0), ("kg", "weight", 1000.0), ("oz", "weight", 28.349523125), ("lb", "weight", 453.59237),
    ("ml", "volume", 1.0), ("l", "volume", 1000.0), ("fl_oz", "volume", 29.5735295625), ("cup", "volume", 236.5882365),
    ("pt", "volume", 473.176473), ("qt", "volume", 946.352946), ("gal", "volume", 3785.411784),
    ("each", "count", 1.0), ("ct", "count", 1.0), ("sheet", "count", 1.0),
)
#: The unit a price is shown in, and base units in one of that.
SHOWN = {
    "lb": ("lb", 453.59237), "oz": ("lb", 453.59237), "g": ("100g", 100.0), "kg": ("kg", 1000.0), "fl_oz": ("fl oz", 29.5735295625),
    "cup": ("fl oz", 29.5735295625), "pt": ("fl oz", 29.5735295625), "qt": ("qt", 946.352946), "gal": ("gal", 3785.411784),
    "ml": ("100ml", 100.0), "l": ("l", 1000.0),
}
BASE = {"weight": "g", "volume": "ml", "count": "each"}
SHAPES = ("in",)
ASSUMED_WEIGHT, WHOLE = "lb", 0.001


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def dimension_of(unit: Column) -> Column:
    return _map({u: d for u, d, _ in UNITS})[unit]


def factor_of(unit: Column) -> Column:
    return _map({u: f for u, _, f in UNITS})[unit]


def to_base(value: Column, unit: Column) -> Column:
    return value * factor_of(unit)


def looks_weighed(quantity: Column) -> Column:
    """A quantity that is no whole number is a weight."""
    return F.coalesce(F.abs(quantity - F.rint(quantity)) > WHOLE, F.lit(False))


def short_number(x: Column) -> Column:
    """Up to six significant digits without trailing zeros, for notes on sizes."""
    scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.nullif(F.abs(x), F.lit(0.0)))))
    return F.regexp_replace(F.coalesce(F.rint(x * scale) / scale, x).cast("string"), r"\.0$", "")


def normalize_line(size_value: Column, size_unit: Column, pack_count: Column, is_capacity: Column, quantity: Column, unit_price: Column, line_total: Column, printed_unit: Column) -> Column:
    """Struct of dimension, base_unit, base_quantity, price_per_base, basis, inferred_unit, note, display_unit, price_per_display.

    Weighed lines are priced by their printed unit (pounds if none), others by the size
    in their description; where there is nothing to divide by, the price is null and ``note`` says why
    (the notes are fixed values).
    """
    weighed = looks_weighed(quantity)
    is_capacity = F.coalesce(is_capacity, F.lit(False))
    none = lambda t: F.lit(None).cast(t)
    count = F.coalesce(F.nullif(quantity, F.lit(0.0)), F.lit(1.0))
    packs = F.coalesce(F.nullif(pack_count, F.lit(0)), F.lit(1))

    def row(dimension, base_quantity, price, basis, inferred=None, note=None, origin=None) -> Column:
        dimension = dimension if dimension is not None else none("string")
        origin = F.lower(origin) if origin is not None else none("string")
        price = price if price is not None else none("double")
        label = F.coalesce(_map({k: v[0] for k, v in SHOWN.items()})[origin], F.when(dimension == "weight", "100g").otherwise("100ml"))
        per = F.coalesce(_map({k: v[1] for k, v in SHOWN.items()})[origin], F.lit(100.0))
        is_count = dimension == "count"
        return F.struct(
            dimension.alias("dimension"),
            _map(BASE)[dimension].alias("base_unit"),
            (base_quantity if base_quantity is not None else none("double")).alias("base_quantity"),
            price.alias("price_per_base"),
            F.lit(basis).alias("basis"),
            (inferred if inferred is not None else none("string")).alias("inferred_unit"),
            (note if note is not None else none("string")).alias("note"),
            F.when(price.isNotNull(), F.when(is_count, "each").otherwise(label)).alias("display_unit"),
            F.when(price.isNotNull(), F.when(is_count, price).otherwise(price * per)).alias("price_per_display"),
        )

    each = F.lit("count")
    unit = F.coalesce(F.nullif(printed_unit, F.lit("")), F.lit(ASSUMED_WEIGHT))
    inferred = F.when(F.nullif(printed_unit, F.lit("")).isNull(), ASSUMED_WEIGHT)
    dim = dimension_of(unit)
    per_unit = F.coalesce(unit_price, F.try_divide(line_total, quantity))
    by_weight = (
        F.when(dim.isNull(), row(None, None, None, "weighed", note=F.concat(F.lit("weighed in '"), unit, F.lit("', which is not a convertible unit"))))
        .when(per_unit.isNull(), row(dim, to_base(quantity, unit), None, "weighed", inferred, F.lit("no unit price and no line total")))
        .otherwise(row(dim, to_base(quantity, unit), per_unit / factor_of(unit), "weighed", inferred, origin=unit))
    )
    item = F.try_divide(line_total, count)
    sdim = dimension_of(size_unit)
    amount = to_base(size_value, size_unit) * count * packs
    no_size = size_unit.isNull() | size_value.isNull()
    what = F.concat(F.coalesce(short_number(size_value), F.lit("")), F.coalesce(size_unit, F.lit("")), F.lit(" is the size of the thing, not how much you got -- priced per item"))
    by_size = (
        F.when(is_capacity & line_total.isNotNull(), row(each, count, item, "unit", note=what, origin=F.lit("each")))
        .when(is_capacity, row(None, None, None, "unit", note=F.lit("size describes the object; no line total")))
        .when(no_size & line_total.isNotNull(), row(each, count, item, "unit", note=F.lit("no package size; comparable per item only"), origin=F.lit("each")))
        .when(no_size, row(None, None, None, "unit", note=F.lit("no package size and no line total")))
        .when(size_unit.isin(*SHAPES), row(None, None, None, "unit", note=F.concat(F.lit("size is a measurement ('"), size_unit, F.lit("'), not an amount"))))
        .when(sdim.isNull(), row(None, None, None, "unit", note=F.concat(F.lit("unconvertible unit '"), size_unit, F.lit("'"))))
        .when(line_total.isNull() | (amount == 0), row(sdim, amount, None, "unit", note=F.lit("no line total to divide")))
        .otherwise(row(sdim, amount, F.try_divide(line_total, amount), "unit", origin=size_unit))
    )
    return F.when(weighed, by_weight).otherwise(by_size)


def price_per_100g(n: Column) -> Column:
    return F.when(n["dimension"] == "weight", n["price_per_base"] * 100)


def price_per_oz(n: Column) -> Column:
    return F.when(n["dimension"] == "weight", n["price_per_base"] * 28.349523125).when(n["dimension"] == "volume", n["price_per_base"] * 29.5735295625)


def is_comparable(n: Column) -> Column:
    return n["price_per_base"].isNotNull()
