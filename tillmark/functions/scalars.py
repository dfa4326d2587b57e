"""Money, keys, categories and other scalar rules as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The categories known at first.
SEED_CATEGORIES = ("produce", "dairy", "meat", "seafood", "bakery", "pantry", "frozen", "beverage", "snack", "household", "personal_care", "pet", "baby")
#: Other words for them.
CATEGORY_SYNONYMS = {
    "dairy_products": "dairy", "refrigerated_dairy": "dairy", "fruits": "produce", "vegetables": "produce", "fruit": "produce",
    "vegetable": "produce", "groceries": "pantry", "grocery": "pantry", "cleaning": "household", "cleaning_supplies": "household",
    "home": "household", "toiletries": "personal_care", "health_and_beauty": "personal_care",
}
#: Units that a parsed size may have.
KNOWN_UNITS = ("g", "kg", "oz", "lb", "ml", "l", "fl_oz", "cup", "pt", "qt", "gal", "each", "ct", "sheet", "in")
PARSER_VERSION = 2


def to_cents(amount: Column) -> Column:
    """Whole cents, halves to even; null stays null."""
    return F.rint(amount * 100).cast("bigint")


def format_cents(cents: Column) -> Column:
    """``12.05`` from 1205; ``--`` from null."""
    a = F.abs(cents)
    whole = F.floor(a / 100).cast("string")
    return F.coalesce(F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((a % 100).cast("string"), 2, "0")), F.lit("--"))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_category(c: Column) -> Column:
    """A stable key for a proposed category; null for none."""
    key = F.replace(F.lower(strip(c)), F.lit("&"), F.lit("and"))
    key = F.regexp_replace(F.regexp_replace(key, r"(?U)[\s/\-]+", "_"), "[^a-z0-9_]", "")
    key = F.nullif(F.regexp_replace(key, "^_+|_+$", ""), F.lit(""))
    synonyms = F.create_map(*(F.lit(x) for kv in CATEGORY_SYNONYMS.items() for x in kv))
    return F.coalesce(synonyms[key], key)


def alias_key(store: Column, description: Column) -> Column:
    """``STORE||description`` under which a printed string is known."""
    return F.concat(F.upper(strip(F.coalesce(F.nullif(store, F.lit("")), F.lit("unknown")))), F.lit("||"), strip(description))


def coerce_parsed(p: Column) -> Column:
    """A parse with what cannot be stood behind set to null; without a product it needs review."""
    unit = F.nullif(F.replace(F.lower(strip(p["size_unit"])), F.lit(" "), F.lit("_")), F.lit(""))
    unit = F.when(unit.isin(*KNOWN_UNITS), unit)
    product = blank_to_null(p["product"])
    return (
        p.withField("size_unit", unit)
        .withField("size_value", F.when(unit.isNotNull(), p["size_value"]))
        .withField("brand", blank_to_null(p["brand"]))
        .withField("product", product)
        .withField("variant", blank_to_null(p["variant"]))
        .withField("category", normalize_category(p["category"]))
        .withField("canonical_text", blank_to_null(p["canonical_text"]))
        .withField("size_is_capacity", F.coalesce(p["size_is_capacity"], F.lit(False)))
        .withField("needs_review", F.coalesce(p["needs_review"], F.lit(False)) | product.isNull())
        .withField("parse_note", blank_to_null(p["parse_note"]))
        .withField("parser_version", F.lit(PARSER_VERSION))
    )


def is_identified(p: Column) -> Column:
    """A parse that names a product and needs no review."""
    return (F.length(F.coalesce(p["product"], F.lit(""))) > 0) & ~F.coalesce(p["needs_review"], F.lit(False))


def is_fresh(p: Column) -> Column:
    """A cached parse of today's parser."""
    return F.coalesce(p["parser_version"], F.lit(1)) >= PARSER_VERSION


def category_label(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def valid_name(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[A-Za-z0-9 ._'-]{2,24}$")


def valid_pin(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[0-9]{4}$")


def iso_now() -> Column:
    """UTC now to the second, under a session in UTC."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def seconds_left(locked_until: Column, now: Column) -> Column:
    """Seconds until a lock ends, at least 0."""
    return F.greatest(F.lit(0), F.unix_timestamp(F.try_to_timestamp(locked_until)) - F.unix_timestamp(now))


def unit_vector(v: Column) -> Column:
    """``v`` scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def retry_after(message: Column) -> Column:
    """Seconds that a provider asks to wait, from its message."""
    said = F.regexp_extract(message, r"(?i)retry in ([0-9.]+)s", 1)
    delay = F.regexp_extract(message, r'"retryDelay"\s*:\s*"([0-9.]+)s"', 1)
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(delay, F.lit(""))).try_cast("double")


def is_daily_quota(message: Column) -> Column:
    """Whether a provider's message says that the day's quota is used up."""
    return F.contains(F.coalesce(message, F.lit("")), F.lit("PerDay"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blob: pd.Series) -> pd.Series:
    """Vectors from little-endian 32-bit floats as older tables hold them."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def vector_to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
