"""The tables behind the pages: dashboard, receipt, and the health of the machine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.operators.ranks import place_in_groups

#: Dollars for a million tokens in and out; thinking counts as out.
PRICE_IN, PRICE_OUT = 0.75, 3.75


def owned(df: DataFrame, shopper_id) -> DataFrame:
    """One shopper's rows."""
    return df.filter(F.col("shopper_id") == shopper_id)


def dashboard_receipts(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Receipts with all their lines counted, voided ones too."""
    n = lines.groupBy("receipt_id").agg(F.count("line_item_id").alias("items"))
    return receipts.join(n, "receipt_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def dashboard_prices(lines: DataFrame, receipts: DataFrame, products: DataFrame) -> DataFrame:
    """Every priced line of a known product, voided ones too."""
    kept = lines.filter(F.col("price_per_display").isNotNull()).select("receipt_id", "product_id", "line_number", "price_per_display", "display_unit", "inferred_unit")
    return kept.join(receipts.select("receipt_id", "shopper_id", "merchant_name", "purchase_date"), "receipt_id").join(products.select("product_id", "canonical_text", "category"), "product_id")


def lifetime_spend(shoppers: DataFrame, receipts: DataFrame) -> DataFrame:
    """Cents that each shopper spent, 0 without receipts."""
    return shoppers.select("shopper_id").join(receipts.select("shopper_id", "total_cents"), "shopper_id", "left").groupBy("shopper_id").agg(F.coalesce(F.sum("total_cents"), F.lit(0)).alias("cents"))


def receipt_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """All lines with the product's name and category where it is known."""
    return lines.join(products.select("product_id", "canonical_text", "category"), "product_id", "left")


def pending_lines(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """Charged lines without a product, counted for each receipt of an owner."""
    open_ = lines.filter((F.col("is_voided") == 0) & F.col("product_id").isNull())
    return open_.join(receipts.filter(F.col("shopper_id").isNotNull()).select("receipt_id"), "receipt_id", "left_semi").groupBy("receipt_id").agg(F.count("*").alias("pending"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in sorted(tables.items())))


def check_totals(checks: DataFrame) -> DataFrame:
    """Passed, failed and uncheckable, and the share that passed of those that ran; nulls on an empty table."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    t = checks.agg(n("pass"), n("fail"), n("uncheckable"))
    share = F.try_divide(F.col("pass") * 1000, F.col("ran"))  # to one decimal, halves to even
    return t.withColumn("ran", F.coalesce("pass", F.lit(0)) + F.coalesce("fail", F.lit(0))).withColumn("pass_rate", F.rint(share) / 10)


def rate(df: DataFrame, condition, name: str) -> DataFrame:
    """How many rows of ``df`` meet ``condition``, and their share in percent; null of an empty table."""
    t = df.agg(F.sum(condition.cast("int")).alias(name), F.count("*").alias("of"))
    return t.withColumn("rate", F.try_divide(F.col(name) * 100, F.col("of")))


def priced_rate(lines: DataFrame) -> DataFrame:
    return rate(lines.filter(F.col("is_voided") == 0), F.col("price_per_display").isNotNull(), "priced")


def parse_rate(aliases: DataFrame) -> DataFrame:
    return rate(aliases, F.col("needs_review") == 0, "parsed")


def token_cost(receipts: DataFrame) -> DataFrame:
    """Tokens of all receipts and what they cost in millionths of a dollar's hundredth, and the share of thinking."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    t = receipts.agg(s("prompt_tokens"), s("output_tokens"), s("thinking_tokens"))
    out = F.col("output_tokens") + F.col("thinking_tokens")
    return t.withColumns({"cost": (F.col("prompt_tokens") * PRICE_IN + out * PRICE_OUT) / 1e6, "thinking_share": F.rint(F.try_divide(F.col("thinking_tokens") * 100, out))})


def receipt_quality(receipts: DataFrame, shoppers: DataFrame, lines: DataFrame, checks: DataFrame) -> DataFrame:
    """How well each receipt was read: lines, lines with a product (null without lines), checks passed and run (null without checks)."""
    n = lines.filter(F.col("is_voided") == 0).groupBy("receipt_id").agg(F.count("line_item_id").alias("lines"), F.sum(F.col("product_id").isNotNull().cast("int")).alias("named"))
    c = checks.groupBy("receipt_id").agg(F.sum((F.col("status") == "pass").cast("int")).alias("passed"), F.sum(F.col("status").isin("pass", "fail").cast("int")).alias("ran"))
    out = receipts.join(shoppers.select("shopper_id", F.col("display_name").alias("who")), "shopper_id", "left").join(n, "receipt_id", "left").join(c, "receipt_id", "left")
    # a receipt without lines still is one row of nulls to the sum of named ones, as in a left join
    return out.select(
        "receipt_id", "merchant_name", "purchase_date", "was_deskewed", "extraction_model", "who",
        F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("named", F.lit(0)).alias("named"), "passed", "ran",
    )


def worklist(aliases: DataFrame, limit: int = 40) -> DataFrame:
    """Strings that need review, most frequent first."""
    g = aliases.filter(F.col("needs_review") == 1).groupBy("store", "raw_description").agg(F.count("*").alias("seen"))
    return g.orderBy(F.desc("seen"), "store", "raw_description").limit(limit)


def failed_checks(checks: DataFrame, limit: int = 30) -> DataFrame:
    """Some failed checks, in a fixed order."""
    return checks.filter(F.col("status") == "fail").orderBy("receipt_id", "check_name", F.coalesce("line_number", F.lit(0))).limit(limit)


def priced_lines(lines: DataFrame) -> DataFrame:
    """Lines that show a price: neither null nor 0."""
    return lines.filter(F.col("price_per_base").isNotNull() & (F.col("price_per_base") != 0))


def receipt_state(checks: DataFrame, lines: DataFrame) -> DataFrame:
    """What a receipt's page says above its lines: checks passed and run, lines that still lack a product."""
    c = checks.groupBy("receipt_id").agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status").isin("pass", "fail")).alias("ran"))
    p = lines.groupBy("receipt_id").agg(F.count_if((F.col("is_voided") == 0) & F.col("product_id").isNull()).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return c.join(p, "receipt_id", "full").select("receipt_id", zero("passed"), zero("ran"), zero("pending"))


def parse_tallies(items: DataFrame, cache_before: DataFrame, cache_after: DataFrame) -> DataFrame:
    """Of a run of the parser: distinct strings, those known before, new ones, those asked twice, those not understood."""
    keys = ["store", "raw_description"]
    mine = items.select(*keys).distinct()
    known = cache_before.select(*keys, F.lit(True).alias("known"))
    rows = mine.join(known, keys, "left").join(cache_after, keys)
    p = F.col("parsed")
    named = (F.length(F.coalesce(p["product"], F.lit(""))) > 0) & ~F.coalesce(p["needs_review"], F.lit(False))
    return rows.agg(
        F.count("*").alias("strings"), F.count_if(F.col("known")).alias("cached"), F.count_if(F.col("known").isNull()).alias("new"),
        F.count_if(F.col("known").isNull() & (p["attempts"] > 1)).alias("retried"), F.count_if(~named).alias("unidentified"),
    )


#: The order in which each page shows its rows; nulls stand first ascending and last descending.
ORDERS = {
    "points": ("product_id", "purchase_date", "receipt_id"),
    "histories": ("-times_bought", "name"),
    "categories": ("-cents",),
    "visits": ("date", "receipt_id"),
    "stores": ("-gap_percent", "-times_bought", "name"),
    "receipts": ("-purchase_date", "-receipt_id"),
    "prices": ("-price_per_display",),
    "lines": ("line_number",),
    "quality": ("-receipt_id",),
    "vocabulary": ("category",),
}


def ranked(df: DataFrame, page: str, by: list[str], then: list[str], large: bool = False) -> DataFrame:
    """``df`` with the place (``rank``) that each row has on its page: one page for each ``by``, ties by ``then``; ``large`` pages are spread over all tasks."""
    keys = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_first(c) for c in (*ORDERS[page], *then)]
    if large:
        return place_in_groups(df, by, keys)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*keys)))


def in_order(df: DataFrame, page: str, limit: int | None = None) -> DataFrame:
    """``df`` as ``page`` shows it, the first ``limit`` rows if given (a top-k plan, no full sort)."""
    keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[page]]
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(limit)
