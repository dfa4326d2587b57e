"""Schemas of the stored tables and of extracted receipts, and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 4

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def struct_of(columns: str, **nested: T.DataType) -> T.StructType:
    """A schema from ``name type, ...`` without a session; types that are not plain come by name."""
    fields = [x.split() for x in columns.split(",")]
    return T.StructType([T.StructField(name, nested[kind] if kind in nested else _TYPES[kind]) for name, kind in fields])


_DDL = {
    "receipts": "receipt_id long, source_file string, merchant_name string, store_number string, purchase_date string, purchase_time string, subtotal_cents long, tax_cents long, total_cents long, tax_rate_percent double, amount_paid_cents long, change_cents long, item_count_printed long, currency string, extraction_model string, prompt_tokens long, output_tokens long, thinking_tokens long, was_deskewed int, ingested_at string, uploaded_by string, shopper_id long",
    "shoppers": "shopper_id long, name_key string, display_name string, pin_hash string, pin_salt string, created_at string, failed_attempts int, locked_until string",
    "products": "product_id string, canonical_text string, product string, brand string, variant string, category string, embedding array<float>, created_at string",
    "product_aliases": "store string, raw_description string, product_id string, parsed_json string, needs_review int",
    "line_items": "line_item_id long, receipt_id long, line_number int, raw_description string, product_id string, quantity double, unit_price_cents long, line_total_cents long, discount_cents long, tax_flag string, is_voided int, dimension string, base_unit string, base_quantity double, price_per_base double, inferred_unit string, normalization_note string, display_unit string, price_per_display double",
    "validation_results": "receipt_id long, check_name string, status string, detail string, line_number int",
    "schema_version": "version int",
}
TABLES: dict[str, T.StructType] = {k: struct_of(v) for k, v in _DDL.items()}

LINE_ITEM = struct_of("line_number int, raw_description string, line_total double, product_code string, quantity double, unit string, unit_price double, discount double, tax_flag string, is_voided boolean")
RECEIPT = struct_of(
    "merchant_name string, store_number string, address string, phone string, purchase_date string, purchase_time string, "
    "line_items lines, subtotal double, tax double, total double, tax_rate_percent double, amount_paid double, "
    "change_given double, rounding_adjustment double, item_count_printed int, currency string, unreadable_notes string",
    lines=T.ArrayType(LINE_ITEM),
)
PARSED = struct_of(
    "raw_description string, brand string, product string, variant string, size_value double, size_unit string, pack_count int, "
    "size_is_capacity boolean, category string, canonical_text string, needs_review boolean, parse_note string, attempts int, parser_version int"
)


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: those it lacks as typed nulls, others dropped."""
    have = {c.lower() for c in df.columns}
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def migrate(df: DataFrame, table: str, version: int) -> DataFrame:
    """A stored table of an older version as of today; a newer version is refused."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"stored version {version} is newer than {SCHEMA_VERSION}")
    return add_missing_columns(df, TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
