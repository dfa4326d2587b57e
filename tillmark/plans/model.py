"""The receipt model over the driver's tables: DataFrames, and the same as SQL views for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.scalars import to_cents

#: Units that a product's number picks its unit from.
UNIT_NAMES = ("lb", "oz", "g", "kg", "fl_oz", "l", "each", "in")


class Model:
    """``shoppers, receipts, line_items, products, aliases, checks`` of one scale factor.

    Shoppers are five groups of customers, or with ``by_customer`` each customer; voided are
    returned lines; some lines have no product, no price or no total.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, by_customer: bool = False) -> None:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        who = F.col("c_custkey") if by_customer else F.col("c_nationkey").cast("bigint") % 5
        customers = read("customer").select("c_custkey", who.alias("shopper_id"))
        self.shoppers = customers.select("shopper_id", F.concat(F.lit("shopper "), F.col("shopper_id").cast("string")).alias("display_name")).distinct()
        k = F.col("o_orderkey")
        self.receipts = (
            read("orders")
            .join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                k.alias("receipt_id"), "shopper_id", F.date_format("o_orderdate", "yyyy-MM-dd").alias("purchase_date"), F.concat(F.lit("store "), (k % 7).cast("string")).alias("merchant_name"),
                to_cents(F.col("o_totalprice")).alias("total_cents"), F.concat(F.lit("order-"), k.cast("string"), F.lit(".jpg")).alias("source_file"),
                F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).cast("int").alias("was_deskewed"), F.concat(F.lit("model "), (k % 2).cast("string")).alias("extraction_model"),
                (1000 + k % 97).alias("prompt_tokens"), (200 + k % 53).alias("output_tokens"), (k % 31).alias("thinking_tokens"),
            )
        )
        n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        micro = F.rint(F.col("l_extendedprice") / F.col("l_quantity") * 1000000).cast("bigint")
        unit = F.get(F.array(*map(F.lit, UNIT_NAMES)), (p % 8).cast("int"))
        self.line_items = read("lineitem").select(
            (F.col("l_orderkey") * 8 + n).alias("line_item_id"), F.col("l_orderkey").alias("receipt_id"), n.alias("line_number"), F.concat(F.lit("ITEM "), p.cast("string")).alias("raw_description"),
            F.when(s % 10 != 0, p).alias("product_id"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.when(s % 9 != 0, F.col("l_extendedprice")).alias("line_total"), F.when(s % 9 != 0, to_cents(F.col("l_extendedprice"))).alias("line_total_cents"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_voided"), F.when(n != 5, micro).alias("price_per_display"), unit.alias("display_unit"),
            F.when(p % 16 == 0, "lb").alias("inferred_unit"), F.when(F.col("l_linestatus") == "F", "N").when(s % 13 != 0, "X").alias("tax_flag"),
        )
        part = read("part")
        self.products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("canonical_text"), F.col("p_brand").alias("brand"), F.nullif(F.col("p_type"), F.lit("PROMO")).alias("category"), F.col("p_size").cast("double").alias("size_value"), F.get(F.array(*map(F.lit, UNIT_NAMES)), (F.col("p_partkey") % 8).cast("int")).alias("size_unit"))
        self.aliases = part.select(F.concat(F.lit("STORE "), (F.col("p_partkey") % 7).cast("string")).alias("store"), F.concat(F.lit("ITEM "), F.col("p_partkey").cast("string")).alias("raw_description"), F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 6 == 0, 1).otherwise(0).alias("needs_review"))

    def printed(self) -> DataFrame:
        """Receipts with amounts in dollars as printed: some a cent off, some not printed."""
        sums = self.line_items.filter("is_voided = 0").groupBy("receipt_id").agg(F.sum("line_total_cents").alias("c"), F.count("*").alias("n"), F.sum(F.when(F.coalesce("tax_flag", F.lit("")) != "N", F.col("line_total_cents"))).alias("t"))
        r = self.receipts.select("receipt_id").join(sums, "receipt_id", "left")
        k, c = F.col("receipt_id"), F.coalesce("c", F.lit(0))
        sub = c + F.when(k % 11 == 0, 1).otherwise(0)
        tax = F.rint(F.coalesce("t", F.lit(0)) * 6 / 100).cast("bigint") + F.when(k % 17 == 0, 5).otherwise(0)
        total = sub + tax + F.when(k % 19 == 0, 1).otherwise(0)
        paid = F.floor((total + 1999) / 2000) * 2000
        return r.select(
            "receipt_id", F.when(k % 23 != 0, sub / 100).alias("subtotal"), F.when(k % 5 != 0, tax / 100).alias("tax"), F.when(k % 29 != 0, total / 100).alias("total"), F.when(k % 7 != 0, 6.0).alias("tax_rate_percent"),
            F.when(k % 3 != 0, paid / 100).alias("amount_paid"), F.when(k % 4 != 0, (total - paid) / 100).alias("change_given"), F.lit(None).cast("double").alias("rounding_adjustment"),
            F.when(k % 2 == 0, F.coalesce("n", F.lit(0)) + F.when(k % 26 == 0, 1).otherwise(0)).cast("int").alias("item_count_printed"),
        )


def views(by_customer: bool = False) -> str:
    """``WITH`` list of the same tables in DuckDB's SQL, to stand before a query."""
    who = "c_custkey" if by_customer else "cast(c_nationkey as bigint) % 5"
    unit = lambda c: "case " + " ".join(f"when {c} % 8 = {i} then '{u}'" for i, u in enumerate(UNIT_NAMES)) + " end"
    return f"""with cust as (select c_custkey, {who} as shopper_id from customer),
shoppers as (select distinct shopper_id, 'shopper ' || cast(shopper_id as varchar) as display_name from cust),
receipts as (select o_orderkey as receipt_id, shopper_id, strftime(o_orderdate, '%Y-%m-%d') as purchase_date, 'store ' || cast(o_orderkey % 7 as varchar) as merchant_name,
  cast(round_even(o_totalprice * 100, 0) as bigint) as total_cents, 'order-' || cast(o_orderkey as varchar) || '.jpg' as source_file,
  case when o_orderkey % 3 = 0 then 0 when o_orderkey % 3 = 1 then 1 end as was_deskewed, 'model ' || cast(o_orderkey % 2 as varchar) as extraction_model,
  1000 + o_orderkey % 97 as prompt_tokens, 200 + o_orderkey % 53 as output_tokens, o_orderkey % 31 as thinking_tokens
  from orders join cust on o_custkey = c_custkey),
line_items as (select l_orderkey * 8 + l_linenumber as line_item_id, l_orderkey as receipt_id, l_linenumber as line_number, 'ITEM ' || cast(l_partkey as varchar) as raw_description,
  case when l_suppkey % 10 <> 0 then l_partkey end as product_id, l_quantity as quantity, l_extendedprice / l_quantity as unit_price,
  case when l_suppkey % 9 <> 0 then l_extendedprice end as line_total, case when l_suppkey % 9 <> 0 then cast(round_even(l_extendedprice * 100, 0) as bigint) end as line_total_cents,
  case when l_returnflag = 'R' then 1 else 0 end as is_voided, case when l_linenumber <> 5 then cast(round_even(l_extendedprice / l_quantity * 1000000, 0) as bigint) end as price_per_display,
  {unit("l_partkey")} as display_unit, case when l_partkey % 16 = 0 then 'lb' end as inferred_unit, case when l_linestatus = 'F' then 'N' when l_suppkey % 13 <> 0 then 'X' end as tax_flag
  from lineitem),
products as (select p_partkey as product_id, p_name as canonical_text, p_brand as brand, nullif(p_type, 'PROMO') as category, cast(p_size as double) as size_value, {unit("p_partkey")} as size_unit from part),
aliases as (select 'STORE ' || cast(p_partkey % 7 as varchar) as store, 'ITEM ' || cast(p_partkey as varchar) as raw_description, p_partkey as product_id, case when p_partkey % 6 = 0 then 1 else 0 end as needs_review from part)"""


PRINTED = """, sums as (select receipt_id, sum(line_total_cents) as c, count(*) as n, sum(case when coalesce(tax_flag, '') <> 'N' then line_total_cents end) as t from line_items where is_voided = 0 group by all),
amounts as (select receipt_id, coalesce(c, 0) + case when receipt_id % 11 = 0 then 1 else 0 end as sub, coalesce(n, 0) as n,
  cast(round_even(coalesce(t, 0) * 6 / 100, 0) as bigint) + case when receipt_id % 17 = 0 then 5 else 0 end as tax from receipts left join sums using (receipt_id)),
totals as (select *, sub + tax + case when receipt_id % 19 = 0 then 1 else 0 end as total from amounts),
printed as (select receipt_id, case when receipt_id % 23 <> 0 then sub / 100 end as subtotal, case when receipt_id % 5 <> 0 then tax / 100 end as tax, case when receipt_id % 29 <> 0 then total / 100 end as total,
  case when receipt_id % 7 <> 0 then 6.0 end as tax_rate_percent, case when receipt_id % 3 <> 0 then floor((total + 1999) / 2000) * 2000 / 100 end as amount_paid,
  case when receipt_id % 4 <> 0 then (total - floor((total + 1999) / 2000) * 2000) / 100 end as change_given,
  case when receipt_id % 2 = 0 then n + case when receipt_id % 26 = 0 then 1 else 0 end end as item_count_printed from totals)"""

CHARGED = """, charged as (select receipt_id, count(*) as n, count(*) filter (line_total is null) as n_missing, sum(cast(round_even(line_total * 100, 0) as bigint)) as cents,
  count(*) filter (line_total is not null and coalesce(tax_flag, '') not in ('N', 'F', 'O')) as n_taxable,
  sum(cast(round_even(line_total * 100, 0) as bigint)) filter (line_total is not null and coalesce(tax_flag, '') not in ('N', 'F', 'O')) as taxable,
  count(*) filter (tax_flag is null) as n_unflagged from line_items where is_voided = 0 group by all),
c as (select cast(round_even(x * 100, 0) as bigint) as y from (select 1.0 as x)),
vals as (select p.receipt_id, cast(round_even(subtotal * 100, 0) as bigint) as sub, cast(round_even(tax * 100, 0) as bigint) as tax, cast(round_even(total * 100, 0) as bigint) as total, tax_rate_percent as rate,
  cast(round_even(amount_paid * 100, 0) as bigint) as paid, abs(cast(round_even(change_given * 100, 0) as bigint)) as change, item_count_printed as printed_n,
  coalesce(n, 0) as n, coalesce(n_missing, 0) as n_missing, coalesce(cents, 0) as cents, coalesce(n_taxable, 0) as n_taxable, coalesce(taxable, 0) as taxable, coalesce(n_unflagged, 0) as n_unflagged
  from printed p left join charged using (receipt_id)),
raw_checks as (
  select receipt_id, 'items_sum_to_subtotal' as check_name, sub is null or n_missing > 0 as un, sub as e, cents as a, 0 as tol, true as money from vals
  union all select receipt_id, 'subtotal_plus_tax_is_total', sub is null or total is null, sub + coalesce(tax, 0), total, 0, true from vals
  union all select receipt_id, 'tax_rate', rate is null or tax is null or n_taxable = 0 or n_unflagged > 0, cast(round_even(taxable * rate / 100, 0) as bigint), tax, 1, true from vals
  union all select receipt_id, 'payment_reconciles', paid is null or change is null or total is null, paid - total, change, 0, true from vals
  union all select receipt_id, 'item_count', printed_n is null, printed_n, n, 0, false from vals),
checks as (
  select receipt_id, check_name, case when un then 'uncheckable' when abs(e - a) <= tol then 'pass' else 'fail' end as status,
    case when not un and money then cast(e as bigint) end as expected_cents, case when not un and money then cast(a as bigint) end as actual_cents, cast(null as int) as line_number from raw_checks
  union all
  select receipt_id, 'line_arithmetic', case when abs(cast(round_even(quantity * unit_price * 100, 0) as bigint) - cast(round_even(line_total * 100, 0) as bigint)) <= 1 then 'pass' else 'fail' end,
    cast(round_even(quantity * unit_price * 100, 0) as bigint), cast(round_even(line_total * 100, 0) as bigint), line_number from line_items where is_voided = 0 and line_total is not null)"""

POINTS = """, points as (select shopper_id, l.product_id, canonical_text as name, category, receipt_id, purchase_date, merchant_name as store, price_per_display as price, display_unit as unit,
  row_number() over (partition by shopper_id, l.product_id order by purchase_date nulls first, receipt_id, line_number, price_per_display) as k
  from line_items l join receipts using (receipt_id) join products p on p.product_id = l.product_id where is_voided = 0 and price_per_display is not null),
histories as (select shopper_id, product_id, arg_min(name, k) as name, arg_min(category, k) as category, count(*) as times_bought, count(distinct nullif(purchase_date, '')) as distinct_dates,
  arg_min(unit, k) as unit, arg_min(price, k) as first_price, arg_max(price, k) as latest_price, arg_max(purchase_date, k) as latest_date, arg_max(store, k) as latest_store, min(price) as cheapest_price, max(price) as dearest_price from points group by all),
changed as (select *, case when distinct_dates >= 2 and first_price <> 0 then (latest_price - first_price) / first_price * 100 end as change_percent from histories),
means as (select shopper_id, product_id, store, sum(price * 1000000) / count(*) / 1000000 as mean, min(k) as seen from points group by all),
compared as (select shopper_id, product_id, count(*) as n, arg_min(store, (mean, seen)) as cheapest_store, min(mean) as cheapest_price, arg_min(store, (-mean, seen)) as dearest_store, max(mean) as dearest_price from means group by all having count(*) >= 2 and max(mean) <> 0)"""
