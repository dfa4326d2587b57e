"""Keyed replace, upsert and cascade as functions from tables to tables.

Each takes the stored rows and the new ones and returns what is stored then; a
writer swaps the result in. Of several new rows with one key the last counts.

Joins are hinted to sort and merge: Spark reckons a few columns of a wide table of mostly nulls so small that it would
broadcast the keys of any number of rows, by way of the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.functions.scalars import alias_key, blank_to_null, strip, to_cents


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def replace_by_key(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``stored`` without the keys of ``new``, and of ``new`` the last row of each key by ``order`` (none: its columns, the greatest row)."""
    new = latest(new, keys, order or [F.desc_nulls_last(c) for c in new.columns if c not in keys])
    return stored.join(new.select(*keys).distinct().hint("merge"), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def save_receipts(stored: DataFrame, new: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Receipts with those of ``new`` in place of rows of the same ``source_file``, and children without lines of replaced ones.

    A replacement keeps the owner that the replaced receipt had.
    """
    owner = stored.filter(F.col("shopper_id").isNotNull()).select("source_file", F.col("shopper_id").alias("_owner"))
    kept_owner = new.join(owner.hint("merge"), "source_file", "left").withColumn("shopper_id", F.coalesce("shopper_id", "_owner")).drop("_owner")
    gone = stored.join(new.select("source_file").hint("merge"), "source_file", "left_semi").select("receipt_id")
    return replace_by_key(stored, kept_owner, ["source_file"], [F.desc("receipt_id")]), *(c.join(gone.hint("merge"), "receipt_id", "left_anti") for c in children)


def receipt_row(r: Column) -> list[Column]:
    """Columns of a stored receipt from an extracted one."""
    text = lambda c: blank_to_null(r[c]).alias(c)
    cents = lambda c, n: to_cents(r[c]).cast("bigint").alias(n)
    return [
        text("merchant_name"), r["store_number"].alias("store_number"), r["purchase_date"].alias("purchase_date"), r["purchase_time"].alias("purchase_time"),
        cents("subtotal", "subtotal_cents"), cents("tax", "tax_cents"), cents("total", "total_cents"), r["tax_rate_percent"].alias("tax_rate_percent"),
        cents("amount_paid", "amount_paid_cents"), F.abs(to_cents(r["change_given"])).alias("change_cents"), r["item_count_printed"].alias("item_count_printed"),
        F.coalesce(F.nullif(r["currency"], F.lit("")), F.lit("USD")).alias("currency"),
    ]


def save_products(stored: DataFrame, new: DataFrame, keep_embedding: bool = True) -> DataFrame:
    """Products upserted by id: creation time stays; an embedding is not wiped by a null one unless asked."""
    old = stored.select("product_id", F.col("created_at").alias("_made"), F.col("embedding").alias("_vector"), F.lit(True).alias("_old"))
    vector = F.coalesce("embedding", "_vector") if keep_embedding else F.col("embedding")
    up = new.join(old.hint("merge"), "product_id", "left").withColumns({"created_at": F.when(F.col("_old"), F.col("_made")).otherwise(F.col("created_at")), "embedding": vector}).select(*stored.columns)
    return replace_by_key(stored, up, ["product_id"], [F.desc_nulls_last("canonical_text")])


def keyed_aliases(new: DataFrame) -> DataFrame:
    """Aliases by upper-cased store (``UNKNOWN`` without one) and trimmed description."""
    key = alias_key(F.col("store"), F.col("raw_description"))
    return new.withColumns({"store": F.substring_index(key, "||", 1), "raw_description": strip(F.col("raw_description"))})


def save_aliases(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases upserted by their key."""
    return replace_by_key(stored, keyed_aliases(new), ["store", "raw_description"])


def delete_receipts(ids: DataFrame, receipts: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Tables without the receipts of ``ids(receipt_id)``; children go with them, products stay."""
    return tuple(t.join(ids.select("receipt_id").distinct().hint("merge"), "receipt_id", "left_anti") for t in (receipts, *children))


def update_lines(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines with the columns of ``changes(line_item_id, ...)`` where it has their id."""
    own = [c for c in changes.columns if c != "line_item_id"]
    c = changes.select("line_item_id", F.struct(*own).alias("_new"))
    return lines.join(c.hint("merge"), "line_item_id", "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{x}")).otherwise(F.col(x)).alias(x) if x in own else F.col(x) for x in lines.columns))


def set_owner(receipts: DataFrame, receipt_id: int, shopper_id: int) -> DataFrame:
    return receipts.withColumn("shopper_id", F.when(F.col("receipt_id") == receipt_id, F.lit(shopper_id)).otherwise(F.col("shopper_id")))
