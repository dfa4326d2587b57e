"""What receipts add up to: price histories, changes, stores, categories, visits, summary and hints.

Every operator works for all shoppers at once; ``shopper_id`` is a key of each group,
and a filter on it reaches the scans. Sums of prices are over whole micro-units, so
that their order does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that a change needs, dates of one product that a spike needs, products that a basket needs.
DAYS_FOR_CHANGE, DAYS_FOR_SPIKE, BASKET = 2, 5, 5
MICRO = 1_000_000


def price_points(lines: DataFrame, receipts: DataFrame, products: DataFrame) -> DataFrame:
    """One row for each priced, charged line of a known product, with ``ord`` to sort a history by."""
    kept = lines.filter((F.col("is_voided") == 0) & F.col("price_per_display").isNotNull()).select(
        "receipt_id", "product_id", "line_number", "price_per_display", "display_unit"
    )
    r = receipts.select("receipt_id", "shopper_id", "purchase_date", "merchant_name")
    p = products.select("product_id", "canonical_text", "category")
    out = kept.join(r, "receipt_id").join(p, "product_id")
    return out.select(
        "shopper_id", "product_id", F.col("canonical_text").alias("name"), "category", "receipt_id", "purchase_date", F.col("merchant_name").alias("store"),
        F.col("price_per_display").alias("price"), F.col("display_unit").alias("unit"),
        F.struct("purchase_date", "receipt_id", "line_number", "price_per_display", "display_unit").alias("ord"),
    )


def histories(points: DataFrame) -> DataFrame:
    """One row for each shopper and product: counts, first, last, least and greatest price, change in percent, stores.

    The change is null below two days, or where the first price is 0. Equal prices are
    told apart by ``ord``, the first of them counts.
    """
    date = F.nullif(F.col("purchase_date"), F.lit(""))
    g = points.groupBy("shopper_id", "product_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.min_by("category", "ord").alias("category"),
        F.count("*").alias("times_bought"),
        F.size(F.collect_set(date)).cast("long").alias("distinct_dates"),
        F.min(F.struct("ord", "unit")).alias("f"),
        F.max(F.struct("ord", "purchase_date", "store", "price", "unit")).alias("l"),
        F.min(F.struct("price", "ord", "store")).alias("lo"),
        F.min(F.struct((-F.col("price")).alias("down"), "ord", "store")).alias("hi"),
        F.size(F.collect_set("unit")).alias("units"),
        F.array_sort(F.collect_set(F.nullif(F.col("store"), F.lit("")))).alias("stores"),
    )
    first, last = F.col("f.ord.price_per_display"), F.col("l.price")
    change = F.when((F.col("distinct_dates") >= DAYS_FOR_CHANGE) & (first != 0), (last - first) / first * 100)
    return g.select(
        "shopper_id", "product_id", "name", "category", "times_bought", "distinct_dates", F.col("f.unit").alias("unit"), first.alias("first_price"),
        last.alias("latest_price"), F.col("l.purchase_date").alias("latest_date"), F.col("l.store").alias("latest_store"),
        F.col("lo.price").alias("cheapest_price"), F.col("lo.store").alias("cheapest_store"), F.col("lo.ord.purchase_date").alias("cheapest_date"),
        (-F.col("hi.down")).alias("dearest_price"), F.col("hi.store").alias("dearest_store"), change.alias("change_percent"), "stores",
        (F.col("units") <= 1).alias("units_consistent"),
    )


def nested_histories(points: DataFrame) -> DataFrame:
    """Histories with their points as an ordered array."""
    return points.groupBy("shopper_id", "product_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.min_by("category", "ord").alias("category"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "purchase_date", "store", "price", "unit"))), lambda x: x.dropFields("ord")).alias("points"),
    )


def price_changes(history: DataFrame) -> DataFrame:
    """Products whose price can be said to have moved, or not."""
    return history.filter(F.col("change_percent").isNotNull())


def store_comparison(points: DataFrame) -> DataFrame:
    """For products bought at two stores or more: the cheapest and the dearest by mean price, and the gap in percent.

    Of equal means the store seen first counts; a product whose dearest mean is 0 is left out; a gap over 0 is null.
    """
    named = points.filter(F.nullif(F.col("store"), F.lit("")).isNotNull())
    mean = named.groupBy("shopper_id", "product_id", "store").agg(
        (F.sum(F.rint(F.col("price") * MICRO).cast("bigint")) / F.count("*") / MICRO).alias("mean"), F.min("ord").alias("seen"), F.count("*").alias("n")
    )
    best = mean.groupBy("shopper_id", "product_id").agg(
        F.count("*").alias("n_stores"), F.min(F.struct("mean", "seen", "store")).alias("lo"), F.min(F.struct((-F.col("mean")).alias("down"), "seen", "store")).alias("hi")
    )
    about = points.groupBy("shopper_id", "product_id").agg(F.min_by("name", "ord").alias("name"), F.min_by("unit", "ord").alias("unit"), F.count("*").alias("times_bought"))
    out = best.filter((F.col("n_stores") >= 2) & (F.col("hi.down") != 0)).join(about, ["shopper_id", "product_id"])
    low, high = F.col("lo.mean"), -F.col("hi.down")
    return out.select(
        "shopper_id", "product_id", "name", "unit", "times_bought", F.col("lo.store").alias("cheapest_store"), low.alias("cheapest_price"),
        F.col("hi.store").alias("dearest_store"), high.alias("dearest_price"), (F.try_divide(high - low, low) * 100).alias("gap_percent"),
    )


def spend_by_category(lines: DataFrame, receipts: DataFrame, products: DataFrame) -> DataFrame:
    """Cents, lines and share of each category of a shopper; lines of no product are ``unsorted``, apart from a category of that name."""
    kept = lines.filter((F.col("is_voided") == 0) & F.col("line_total_cents").isNotNull()).select("receipt_id", "product_id", "line_total_cents")
    joined = kept.join(receipts.select("receipt_id", "shopper_id"), "receipt_id").join(products.select("product_id", "category"), "product_id", "left")
    g = joined.groupBy("shopper_id", "category").agg(F.sum("line_total_cents").alias("cents"), F.count("*").alias("items"))
    total = F.expr("sum(cents) over (partition by shopper_id)")
    return g.select(
        "shopper_id", F.coalesce("category", F.lit("unsorted")).alias("category"), "cents", (F.col("cents") / 100).alias("spent"), "items",
        (F.col("cents") / F.when(total == 0, 1).otherwise(total) * 100).alias("share"),
    )


def spend_over_time(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each receipt with its charged lines; a receipt without any has 0."""
    n = lines.filter(F.col("is_voided") == 0).groupBy("receipt_id").agg(F.count("line_item_id").alias("items"))
    return receipts.join(n, "receipt_id", "left").select(
        "shopper_id", "receipt_id", F.col("purchase_date").alias("date"), F.col("merchant_name").alias("store"),
        (F.coalesce("total_cents", F.lit(0)) / 100).alias("spent"), F.coalesce("total_cents", F.lit(0)).alias("cents"), F.coalesce("items", F.lit(0)).alias("items"),
    )


def summary(shoppers: DataFrame, receipts: DataFrame, history: DataFrame) -> DataFrame:
    """The numbers at the top of a shopper's page; shoppers without receipts too."""
    date = F.nullif(F.col("purchase_date"), F.lit(""))
    visits = receipts.groupBy("shopper_id").agg(
        F.count("*").alias("shops"), F.sum(F.coalesce("total_cents", F.lit(0))).alias("cents"), F.count_distinct(date).alias("days"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    micro = F.rint(F.col("change_percent") * MICRO).cast("bigint")
    of = history.groupBy("shopper_id").agg(F.count("*").alias("products"), F.count("change_percent").alias("repeat_products"), (F.sum(micro) / F.count("change_percent") / MICRO).alias("average_change"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = shoppers.select("shopper_id").join(visits, "shopper_id", "left").join(of, "shopper_id", "left")
    total = F.coalesce("cents", F.lit(0)) / 100
    return out.select(
        "shopper_id", zero("shops"), total.alias("total_spent"), F.coalesce(F.try_divide(total, F.col("shops")), F.lit(0.0)).alias("average_shop"), zero("products"), zero("repeat_products"),
        F.coalesce("days", F.lit(0)).alias("days_covered"), "first_date", "last_date", "average_change",
    )


#: What each hint is about, what it takes (None: depends on the shopper), and why.
HINTS = (
    ("Whether prices are going up or down", None, "A price needs readings on two separate days before it can be said to have moved."),
    ("Which store is cheaper for what you actually buy", "Buy the same item at a second store", "Comparing whole baskets mostly measures what you bought, not what things cost."),
    ("Your spending trend", "Buy something on a different day", "Everything so far is from a single date."),
    ("Your own inflation rate", f"About {BASKET} regular items priced on two separate store visits", "An index compares the same basket at two times. Fewer items and one price swing swamps the number."),
    ("Spotting a price that spiked", None, "Calling something unusual needs enough history to know what usual looks like."),
)


def unlock_hints(shoppers: DataFrame, receipts: DataFrame, points: DataFrame) -> DataFrame:
    """What each shopper still lacks for an answer, in the order of ``HINTS``; ``rank`` is 1 to 5."""
    h = histories(points)
    of = h.groupBy("shopper_id").agg(
        F.count("*").alias("products"), F.count("change_percent").alias("changes"), F.max("distinct_dates").alias("deepest"), F.min(F.struct((-F.col("times_bought")).alias("down"), "name")).alias("most")
    )
    dates = points.groupBy("shopper_id").agg(F.count_distinct(F.nullif(F.col("purchase_date"), F.lit(""))).alias("dates"))
    pairs = store_comparison(points).groupBy("shopper_id").agg(F.count("*").alias("compared"))
    visits = receipts.groupBy("shopper_id").agg(F.count("*").alias("visits"))
    s = shoppers.select("shopper_id")
    for side in (of, dates, pairs, visits):
        s = s.join(side, "shopper_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    fires = (n("changes") == 0, (n("compared") == 0) & (n("visits") > 0), n("dates") < 2, (n("products") < BASKET) | (n("dates") < 2), n("deepest") < DAYS_FOR_SPIKE)
    needs = {
        0: F.concat(F.lit("Buy "), F.coalesce("most.name", F.lit("something")), F.lit(" again on a different day")),
        4: F.concat(F.lit(f"{DAYS_FOR_SPIKE} purchases of the same item (best so far: "), n("deepest").cast("string"), F.lit(")")),
    }
    rows = [F.when(f, F.struct(F.lit(k + 1).alias("rank"), F.lit(what).alias("what"), (needs[k] if k in needs else F.lit(need)).alias("needs"), F.lit(why).alias("why"))) for k, (f, (what, need, why)) in enumerate(zip(fires, HINTS, strict=True))]
    return s.select("shopper_id", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
