"""More named queries over the driver tables: orders of pages, keyed writes, scalar rules, catalog growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.functions import scalars, units
from tillmark.operators import analysis, matching, pages, resolution, storage, validation
from tillmark.plans import catalogue
from tillmark.plans.catalogue import CHARGED, POINTS, PRINTED, V, _checks, _decisions, _catalog, _parsed, _points, query
from tillmark.sources import schemas
from tillmark.sources.shared import shared_folder
from tillmark.sources.store import Store

REGISTERED = (catalogue._QUERIES, catalogue._SQL)


def _rank(order: str) -> str:
    return f"cast(row_number() over (partition by shopper_id order by {order}) as int) as rank"


@query(V + POINTS + " select shopper_id, product_id, receipt_id, price, " + _rank("product_id nulls first, purchase_date nulls first, receipt_id nulls first, k") + " from points")
def points_order(m):
    """ST-1: price points as a history lists them."""
    p = _points(m).withColumn("k", F.expr("row_number() over (partition by shopper_id, product_id order by ord)"))
    return pages.ranked(p, "points", ["shopper_id"], ["k"], large=True).select("shopper_id", "product_id", "receipt_id", "price", "rank")


@query(V + POINTS + " select * from (select shopper_id, product_id, times_bought, name, " + _rank("times_bought desc, name, product_id") + " from changed) where rank <= 20")
def histories_first(m):
    """ST-2, ST-12: the twenty products that a shopper bought most."""
    return pages.ranked(analysis.histories(_points(m)), "histories", ["shopper_id"], ["product_id"]).filter("rank <= 20").select("shopper_id", "product_id", "times_bought", "name", "rank")


@query(V + """, g as (select shopper_id, coalesce(category, 'unsorted') as category, cast(sum(line_total_cents) as bigint) as cents from line_items l join receipts using (receipt_id) left join products p on p.product_id = l.product_id
  where is_voided = 0 and line_total_cents is not null group by all) select *, """ + _rank("cents desc, category nulls first") + " from g")
def categories_order(m):
    """ST-3: categories by what they cost."""
    return pages.ranked(analysis.spend_by_category(m.line_items, m.receipts, m.products), "categories", ["shopper_id"], ["category"]).select("shopper_id", "category", "cents", "rank")


@query(V + " select shopper_id, receipt_id, purchase_date as date, " + _rank("purchase_date nulls first, receipt_id") + " from receipts")
def visits_order(m):
    """ST-4: visits from the first on."""
    return pages.ranked(analysis.spend_over_time(m.receipts, m.line_items), "visits", ["shopper_id"], [], large=True).select("shopper_id", "receipt_id", "date", "rank")


@query(V + POINTS + " select shopper_id, product_id, gap, " + _rank("gap desc nulls last, product_id") + " from (select shopper_id, product_id, round_even((dearest_price - cheapest_price) / cheapest_price * 1e8, 0) as gap from compared)")
def stores_order(m):
    """ST-5: products by how far stores differ."""
    c = analysis.store_comparison(_points(m)).select("shopper_id", "product_id", F.rint(F.col("gap_percent") * 1e6).alias("gap_percent"), F.lit(0).alias("times_bought"), F.lit("").alias("name"))
    return pages.ranked(c, "stores", ["shopper_id"], ["product_id"]).select("shopper_id", "product_id", F.col("gap_percent").alias("gap"), "rank")


@query(V + " select shopper_id, receipt_id, purchase_date, " + _rank("purchase_date desc nulls last, receipt_id desc") + " from receipts")
def receipts_order(m):
    """ST-6: the latest receipts first."""
    return pages.ranked(m.receipts, "receipts", ["shopper_id"], [], large=True).select("shopper_id", "receipt_id", "purchase_date", "rank")


@query(V + " select shopper_id, receipt_id, line_number, product_id, price_per_display, " + _rank("price_per_display desc nulls last, receipt_id, line_number, product_id") + " from line_items join receipts using (receipt_id) where price_per_display is not null and product_id is not null")
def prices_order(m):
    """ST-7: priced lines, dearest first."""
    p = pages.dashboard_prices(m.line_items, m.receipts, m.products)
    return pages.ranked(p, "prices", ["shopper_id"], ["receipt_id", "line_number", "product_id"], large=True).select("shopper_id", "receipt_id", "line_number", "product_id", "price_per_display", "rank")


@query(V + " select receipt_id, line_number, raw_description, quantity, cast(row_number() over (partition by receipt_id order by line_number nulls first, raw_description, quantity) as int) as rank from line_items")
def lines_order(m):
    """ST-8: lines of a receipt as printed."""
    return pages.ranked(m.line_items, "lines", ["receipt_id"], ["raw_description", "quantity"]).select("receipt_id", "line_number", "raw_description", "quantity", "rank")


@query(V + " select shopper_id, receipt_id, " + _rank("receipt_id desc") + " from receipts")
def quality_order(m):
    """ST-9: receipts of the quality page, the newest first."""
    return pages.ranked(m.receipts, "quality", ["shopper_id"], [], large=True).select("shopper_id", "receipt_id", "rank")


@query(V + " select receipt_id, source_file, total_cents from receipts where shopper_id = 3")
def owned_receipts(m):
    """FP-1, FP-2: one shopper's receipts."""
    return pages.owned(m.receipts, 3).select("receipt_id", "source_file", "total_cents")


@query(V + " select receipt_id, line_number, price_per_display as price_per_base from line_items where price_per_display is not null and price_per_display <> 0")
def priced_lines(m):
    """FP-7: lines with a price that is neither null nor 0."""
    return pages.priced_lines(m.line_items.withColumn("price_per_base", F.col("price_per_display"))).select("receipt_id", "line_number", "price_per_base")


@query(V + POINTS + " select shopper_id, product_id, array_to_string(list_sort(list(distinct store) filter (store <> '')), ',') as stores from points group by all")
def product_stores(m):
    """AG-10, SO-3: the stores that had each product, sorted."""
    return analysis.histories(_points(m)).select("shopper_id", "product_id", F.array_join("stores", ",").alias("stores"))


@query(V + PRINTED + CHARGED + """, k as (select receipt_id, count(*) filter (status = 'pass') as passed, count(*) filter (status <> 'uncheckable') as ran from checks group by all),
p as (select receipt_id, count(*) filter (is_voided = 0 and product_id is null) as pending from line_items group by all)
select receipt_id, coalesce(passed, 0) as passed, coalesce(ran, 0) as ran, coalesce(pending, 0) as pending from k full join p using (receipt_id)""")
def receipt_states(m):
    """AG-25: checks and pending lines of each receipt."""
    return pages.receipt_state(_checks(m), m.line_items)


@query(V + PRINTED + CHARGED + " select receipt_id, check_name, line_number, actual_cents - expected_cents as delta_cents from checks")
def check_deltas(m):
    """VC-9: how far each check is off."""
    return _checks(m).select("receipt_id", "check_name", "line_number", "delta_cents")


_MONEY = "case when {0} is null then '--' else case when {0} < 0 then '-' else '' end || cast(abs({0}) // 100 as varchar) || '.' || lpad(cast(abs({0}) % 100 as varchar), 2, '0') end"
_OWED = "cast(round_even(taxable * rate / 100, 0) as bigint)"
_SUMS = f"cast(n as varchar) || ' items sum to ' || {_MONEY.format('cents')}"
_ADDED = f"{_MONEY.format('sub')} || ' + ' || {_MONEY.format('coalesce(tax, 0)')} || ' = '"


@query(V + PRINTED + CHARGED + f""", m as (select receipt_id, '[' || string_agg(cast(line_number as varchar), ', ' order by line_number) || ']' as missing from line_items where is_voided = 0 and line_total is null group by all)
select receipt_id, 'items_sum_to_subtotal' as check_name, case when sub is null then 'no subtotal printed' when n_missing > 0 then 'line(s) ' || missing || ' have no amount, so no sum is possible' when sub = cents then {_SUMS}
  else {_SUMS} || ' but the printed subtotal is ' || {_MONEY.format('sub')} || ' (off by ' || {_MONEY.format('abs(cents - sub)')} || ')' end as detail from vals left join m using (receipt_id)
union all select receipt_id, 'subtotal_plus_tax_is_total', case when sub is null or total is null then 'subtotal or total not printed' when sub + coalesce(tax, 0) = total then {_ADDED} || {_MONEY.format('total')}
  else {_ADDED} || {_MONEY.format('(sub + coalesce(tax, 0))')} || ' but the printed total is ' || {_MONEY.format('total')} end from vals
union all select receipt_id, 'item_count', case when printed_n is null then 'no item count printed' when printed_n = n then 'extracted ' || cast(n as varchar) || ' items, receipt says ' || cast(printed_n as varchar)
  else 'extracted ' || cast(n as varchar) || ' items but the receipt says ' || cast(printed_n as varchar) || ' -- a line was dropped or invented' end from vals
union all select receipt_id, 'tax_rate', case when rate is null then 'no tax rate printed' when tax is null then 'no tax amount printed' when n_taxable = 0 then 'no line items are flagged taxable' when n_unflagged > 0 then 'some lines have no tax flag printed'
  else cast(n_taxable as varchar) || ' taxable items = ' || {_MONEY.format('taxable')} || ' x ' || cast(cast(rate as int) as varchar) || '% = ' || case when abs({_OWED} - tax) <= 1 then {_MONEY.format('tax')}
  else {_MONEY.format(_OWED)} || ' but the printed tax is ' || {_MONEY.format('tax')} || ' -- a tax flag or an amount is misread' end end from vals
union all select receipt_id, 'payment_reconciles', case when paid is null or change is null then 'payment or change not printed' when total is null then 'no total printed'
  else 'paid ' || {_MONEY.format('paid')} || ' - total ' || {_MONEY.format('total')} || ' = ' || case when paid - total = change then 'change ' || {_MONEY.format('change')} else {_MONEY.format('(paid - total)')} || ' but the printed change is ' || {_MONEY.format('change')} end end from vals""")
def check_details(m):
    """VC-1, VC-2, VC-4, VC-5, VC-6, SF-2, SF-7: what a page says of the checks of a receipt."""
    return _checks(m).filter("check_name <> 'line_arithmetic'").select("receipt_id", "check_name", "detail")


@query(V + PRINTED + CHARGED + """, k as (select receipt_id, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'fail') as failed, count(*) filter (status = 'uncheckable') as un from checks group by all)
select receipt_id, passed + failed as evidence, case when passed + failed = 0 then 'no checks could run -- this receipt proves nothing about itself' else case when failed = 0 then 'TRUSTWORTHY' else 'NEEDS REVIEW' end || ': ' || cast(passed as varchar) || '/' || cast(passed + failed as varchar)
  || ' checks passed' || case when un > 0 then ', ' || cast(un as varchar) || ' not printed' else '' end end as summary from k""")
def report_summaries(m):
    """VC-8: one line on each receipt."""
    return validation.report(_checks(m)).select("receipt_id", "evidence", "summary")


@query(V + PRINTED + " select receipt_id, cast(round_even(coalesce(sum(line_total) filter (is_voided = 0), 0) * 100, 0) as bigint) as summed from printed left join line_items using (receipt_id) group by receipt_id")
def previews(m):
    """VC-10: what the console's preview sums up, in cents."""
    return validation.preview(m.printed(), m.line_items).select("receipt_id", scalars.to_cents(F.col("summed")).alias("summed"))


@query(V + """ select receipt_id, shopper_id, source_file, total_cents from receipts where receipt_id % 4 <> 0
union all select receipt_id + 30000000, shopper_id, source_file, total_cents + 3 from receipts where receipt_id % 4 = 0""")
def upsert_twice_in_a_batch(m):
    """SK-1, WN-6, JN-14: a file that comes three times in one batch is stored once, as it came last."""
    r = m.receipts.select("receipt_id", "shopper_id", "source_file", "total_cents")
    again = r.filter("receipt_id % 4 = 0").select(F.explode(F.array(*map(F.lit, (1, 3, 2)))).alias("t"), "*")
    again = again.select((F.col("receipt_id") + F.col("t") * 10_000_000).alias("receipt_id"), F.lit(None).cast("bigint").alias("shopper_id"), "source_file", (F.col("total_cents") + F.col("t")).alias("total_cents"))
    return storage.save_receipts(r, again)[0].select("receipt_id", "shopper_id", "source_file", "total_cents")


@query(V + """ select cast(product_id as varchar) as product_id, case when product_id % 3 = 0 then canonical_text || ' new' else canonical_text end as canonical_text, 't0' as created_at, 1 as has_vector from products
union all select 'n' || cast(product_id as varchar), canonical_text, 't1', 0 from products where product_id % 3 = 1""")
def product_upsert(m):
    """SK-3: known products keep their time and vector, new ones are added, each once."""
    p = m.products.select(F.col("product_id").cast("string").alias("product_id"), "canonical_text", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("t0").alias("created_at"), F.col("product_id").alias("k"))
    none = F.lit(None).cast("array<float>")
    new = p.filter("k % 3 = 0").select("product_id", F.explode(F.array(F.concat("canonical_text", F.lit(" new")), F.lit(None))).alias("canonical_text"), none.alias("embedding"), F.lit("t1").alias("created_at"))
    more = p.filter("k % 3 = 1").select(F.concat(F.lit("n"), "product_id").alias("product_id"), "canonical_text", none.alias("embedding"), F.lit("t1").alias("created_at"))
    out = storage.save_products(p.drop("k"), new.unionByName(more))
    return out.select("product_id", "canonical_text", "created_at", F.col("embedding").isNotNull().cast("int").alias("has_vector"))


@query(V + """ select store, raw_description, case when product_id % 5 = 0 then product_id + 2 else product_id end as product_id from aliases
union all select 'UNKNOWN', raw_description, product_id from aliases where product_id % 5 = 1""")
def alias_upsert(m):
    """SK-4, SF-8, ER-10: aliases by upper-cased store and trimmed string, the last of a batch; no store is UNKNOWN."""
    a = m.aliases.select("store", "raw_description", "product_id")
    again = a.filter("product_id % 5 = 0").select(F.concat(F.lit(" "), F.lower("store")).alias("store"), F.concat("raw_description", F.lit("  ")).alias("raw_description"), F.explode(F.array(F.col("product_id") + 1, F.col("product_id") + 2)).alias("product_id"))
    none = a.filter("product_id % 5 = 1").select(F.lit(None).cast("string").alias("store"), "raw_description", "product_id")
    return storage.save_aliases(a, again.unionByName(none))


@query(V + " select line_item_id, line_number, quantity, case when line_item_id % 4 = 0 and product_id is null then -1 else product_id end as product_id, case when line_item_id % 4 = 0 and product_id is null then 'each' else display_unit end as display_unit from line_items")
def line_update(m):
    """SK-7: lines that were looked up later."""
    found = m.line_items.filter("line_item_id % 4 = 0 and product_id is null").select("line_item_id", F.lit(-1).cast("bigint").alias("product_id"), F.lit("each").alias("display_unit")).distinct()
    # a number is not unique in these tables: only those without a product change
    open_, rest = m.line_items.filter("product_id is null"), m.line_items.filter("product_id is not null")
    return storage.update_lines(open_, found).unionByName(rest).select("line_item_id", "line_number", "quantity", "product_id", "display_unit")


@query(V + " select receipt_id, case when receipt_id = 7 then 99 else shopper_id end as shopper_id from receipts")
def owner_set(m):
    """SK-8: a receipt given to another shopper."""
    return storage.set_owner(m.receipts, 7, 99).select("receipt_id", "shopper_id")


@query(V + " select receipt_id, source_file, total_cents, cast(null as varchar) as uploaded_by, cast(null as bigint) as shopper_id, cast(null as double) as tax_rate_percent from receipts")
def migrated_receipts(m):
    """SC-1, SC-2, SC-3: a table of the first version as of today."""
    return schemas.migrate(m.receipts.select("receipt_id", "source_file", "merchant_name", "total_cents"), "receipts", 1).select("receipt_id", "source_file", "total_cents", "uploaded_by", "shopper_id", "tax_rate_percent")


_AGAIN = 10_000_000


@query(V + f""", r as (select receipt_id as was, receipt_id, shopper_id, source_file, total_cents from receipts where receipt_id % 5 <> 0
  union all select receipt_id, receipt_id + {_AGAIN}, shopper_id, source_file, total_cents + 1 from receipts where receipt_id % 5 = 0)
select r.receipt_id, r.shopper_id, source_file, total_cents, count(l.receipt_id) as n_lines, coalesce(cast(sum(l.line_total_cents) as bigint), 0) as line_cents, count(p.product_id) as n_named
from r left join line_items l on l.receipt_id = r.was and (r.receipt_id < {_AGAIN} or l.line_number <= 2) left join products p on p.product_id = l.product_id where r.receipt_id % 7 <> 0 group by all""")
def store_commits(m):
    """SK-1 to SK-6: all receipts committed with their lines, every fifth taken in again with fewer lines, every seventh deleted; read back from the store."""
    store = Store(m.spark, shared_folder(m.spark, "store"), buckets=32)
    r = m.receipts.select("receipt_id", "shopper_id", "source_file", "total_cents")
    li = m.line_items.select("line_item_id", "receipt_id", "line_number", "raw_description", F.col("product_id").cast("string").alias("product_id"), "line_total_cents", "is_voided")

    def commit(change) -> None:  # noqa: ANN001
        tx = store.begin()
        change(tx)
        tx.commit()
        tx.close()

    def all_of_it(tx) -> None:  # noqa: ANN001
        tx.put("shoppers", m.shoppers.select(F.col("shopper_id").cast("long").alias("shopper_id"), "display_name"))
        tx.save_products(m.products.select(F.col("product_id").cast("string").alias("product_id"), "canonical_text"))
        tx.save_receipts(r, li)

    later = (F.col("receipt_id") + _AGAIN).alias("receipt_id")
    again = r.filter("receipt_id % 5 = 0").select(later, "source_file", (F.col("total_cents") + 1).alias("total_cents"))
    fewer = li.join(r.filter("receipt_id % 5 = 0").select("receipt_id").hint("merge"), "receipt_id", "left_semi").filter("line_number <= 2").select(*(later if c == "receipt_id" else F.col(c) for c in li.columns))
    commit(all_of_it)
    commit(lambda tx: tx.save_receipts(again, fewer))
    commit(lambda tx: tx.delete_receipts(store.snapshot().table("receipts").filter("receipt_id % 7 = 0").select("receipt_id")))
    now = store.snapshot()
    stored = now.table("line_items").select("receipt_id", "product_id", "line_total_cents")
    products = now.table("products").select("product_id", F.lit(1).alias("named")).hint("merge")
    # lines without a product would all meet in one task of the join
    named = stored.filter("product_id is not null").join(products, "product_id", "left").unionByName(stored.filter("product_id is null"), allowMissingColumns=True)
    sums = named.groupBy("receipt_id").agg(F.count("*").alias("n_lines"), F.sum("line_total_cents").alias("line_cents"), F.count("named").alias("n_named"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return now.table("receipts").join(sums.hint("merge"), "receipt_id", "left").select("receipt_id", "shopper_id", "source_file", "total_cents", zero("n_lines"), zero("line_cents"), zero("n_named"))


_KINDS = {"weight": [u for u, d, _ in units.UNITS if d == "weight"], "volume": [u for u, d, _ in units.UNITS if d == "volume"], "count": [u for u, d, _ in units.UNITS if d == "count"]}
_DIMENSION = "case " + " ".join(f"when unit in ({', '.join(repr(u) for u in us)}) then '{d}'" for d, us in _KINDS.items()) + " end"


@query(V + f""", x as (select receipt_id, line_number, l.product_id, line_total, unit_price, size_value, size_unit, case when line_number % 4 = 0 then quantity + 0.25 else quantity end as q, case when line_number % 3 = 0 then 'kg' when line_number % 3 = 1 then 'oz' end as printed,
  case when l.product_id % 7 = 0 then 1 else 0 end as capacity, case when l.product_id % 3 = 0 then 6 end as packs from line_items l join products p on p.product_id = l.product_id),
y as (select *, q <> floor(q) as weighed, case when q <> floor(q) then coalesce(printed, 'lb') else size_unit end as unit from x),
z as (select *, {catalogue._FACTOR} as factor, {_DIMENSION} as dim from y),
w as (select *, case when weighed then unit_price / factor when capacity = 1 then line_total / q when unit = 'in' or line_total is null then null else line_total / (size_value * factor * q * coalesce(packs, 1)) end as price,
  case when weighed then dim when capacity = 1 then case when line_total is not null then 'count' end when unit = 'in' then null else dim end as dimension from z)
select receipt_id, line_number, product_id, dimension, price as price_per_base, case when weighed and printed is null then 'lb' end as inferred_unit,
  case when weighed then null when capacity = 1 and line_total is not null then cast(cast(size_value as int) as varchar) || size_unit || ' is the size of the thing, not how much you got -- priced per item' when capacity = 1 then 'size describes the object; no line total'
    when unit = 'in' then 'size is a measurement (''in''), not an amount' when line_total is null then 'no line total to divide' end as note,
  case when dimension = 'weight' then price * 100 end as per_100g, case when dimension = 'weight' then price * 28.349523125 when dimension = 'volume' then price * 29.5735295625 end as per_oz, price is not null as comparable from w""")
def normalize_variants(m):
    """UN-4 to UN-6, UN-8 to UN-10, SF-5: printed units, capacities and packs, with notes and prices by weight."""
    lines = m.line_items.join(m.products, "product_id")
    n, p = F.col("line_number"), F.col("product_id")
    q = F.when(n % 4 == 0, F.col("quantity") + 0.25).otherwise(F.col("quantity"))
    printed = F.when(n % 3 == 0, "kg").when(n % 3 == 1, "oz")
    row = units.normalize_line(F.col("size_value"), F.col("size_unit"), F.when(p % 3 == 0, 6).cast("int"), p % 7 == 0, q, F.col("unit_price"), F.col("line_total"), printed)
    x = F.col("n")
    return lines.select("receipt_id", "line_number", "product_id", row.alias("n")).select(
        "receipt_id", "line_number", "product_id", "n.dimension", "n.price_per_base", "n.inferred_unit", "n.note", units.price_per_100g(x).alias("per_100g"), units.price_per_oz(x).alias("per_oz"), units.is_comparable(x).alias("comparable")
    )


@query(f"select l_orderkey as receipt_id, l_linenumber as line_number, l_partkey as product_id, {_MONEY.format('cents')} as shown from (select *, cast(round_even(l_extendedprice * 100, 0) as bigint) * case when l_partkey % 5 = 0 then -1 when l_partkey % 7 <> 0 then 1 end as cents from lineitem)")
def format_cents(m):
    """SF-2: cents as money, nulls and negative ones too."""
    k = F.col("l_partkey")
    cents = scalars.to_cents(F.col("l_extendedprice")) * F.when(k % 5 == 0, -1).when(k % 7 != 0, 1)
    return m.spark.read.parquet(f"{m.dir}/lineitem.parquet").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("line_number"), k.alias("product_id"), scalars.format_cents(cents).alias("shown"))


@query("""with k as (select p_partkey as product_id, p_name, case p_partkey % 5 when 0 then 'retry in ' || cast(p_size as varchar) || '.5s' when 1 then '{"retryDelay": "' || cast(p_size as varchar) || 's"}' when 2 then 'GenerateRequestsPerDayPerProject' when 3 then 'the daily quota' end as said from part)
select product_id, replace(p_name, '_', ' ') as label, regexp_matches(p_name, '^[A-Za-z0-9 ._''-]{2,24}$') as name_ok, regexp_matches(cast(product_id as varchar), '^[0-9]{4}$') as pin_ok,
  cast(coalesce(nullif(regexp_extract(said, 'retry in ([0-9.]+)s', 1), ''), nullif(regexp_extract(said, '"retryDelay": "([0-9.]+)s"', 1), '')) as double) as wait, coalesce(contains(said, 'PerDay'), false) as spent,
  product_id % 3 <> 1 and product_id % 3 <> 2 as fresh, nullif(trim(case when product_id % 4 = 0 then '   ' else p_name end), '') as brand from k""")
def scalar_rules(m):
    """SF-9, SF-15, SF-18, SF-19, SF-26, FP-9: labels, names, numbers, waits, spent quotas, stale parses, blanks."""
    k, name = F.col("p_partkey"), F.col("p_name")
    size = F.col("p_size").cast("string")
    said = F.when(k % 5 == 0, F.concat(F.lit("retry in "), size, F.lit(".5s"))).when(k % 5 == 1, F.concat(F.lit('{"retryDelay": "'), size, F.lit('s"}'))).when(k % 5 == 2, "GenerateRequestsPerDayPerProject").when(k % 5 == 3, "the daily quota")
    parse = F.struct(F.when(k % 3 == 0, 2).when(k % 3 == 1, 1).alias("parser_version"))
    return m.spark.read.parquet(f"{m.dir}/part.parquet").select(
        k.alias("product_id"), scalars.category_label(name).alias("label"), scalars.valid_name(name).alias("name_ok"), scalars.valid_pin(k.cast("string")).alias("pin_ok"), scalars.retry_after(said).alias("wait"),
        scalars.is_daily_quota(said).alias("spent"), scalars.is_fresh(parse).alias("fresh"), scalars.blank_to_null(F.when(k % 4 == 0, "   ").otherwise(name)).alias("brand"),
    )


@query("""select p_partkey as product_id, case p_partkey % 4 when 0 then 'fl_oz' when 1 then 'kg' end as size_unit, case when p_partkey % 4 < 2 then cast(p_size as double) end as size_value, case when p_partkey % 3 <> 0 then p_name end as product, p_partkey % 3 = 0 as needs_review, 2 as parser_version from part""")
def coerce_parses(m):
    """SF-4: parses with what cannot be stood behind taken out."""
    k = F.col("p_partkey")
    unit = F.when(k % 4 == 0, " Fl Oz ").when(k % 4 == 1, "KG").when(k % 4 == 2, "parsec").otherwise("")
    no = lambda t: F.lit(None).cast(t)
    p = F.struct(
        no("string").alias("raw_description"), no("string").alias("brand"), F.when(k % 3 == 0, " ").otherwise(F.col("p_name")).alias("product"), no("string").alias("variant"), F.col("p_size").cast("double").alias("size_value"), unit.alias("size_unit"),
        no("int").alias("pack_count"), no("boolean").alias("size_is_capacity"), no("string").alias("category"), no("string").alias("canonical_text"), no("boolean").alias("needs_review"), no("string").alias("parse_note"), no("int").alias("attempts"), no("int").alias("parser_version"),
    )
    got = m.spark.read.parquet(f"{m.dir}/part.parquet").select(k.alias("product_id"), scalars.coerce_parsed(p).alias("p"))
    return got.select("product_id", "p.size_unit", "p.size_value", "p.product", "p.needs_review", "p.parser_version")


@query("select vec_id, cast(len(embedding) as int) as n, cast(embedding[1] as double) as first, cast(embedding[64] as double) as last from embeddings")
def vector_blobs(m):
    """SK-12: vectors to bytes and back."""
    e = m.spark.read.parquet(f"{m.dir}/embeddings.parquet").select("vec_id", scalars.blob_to_vector(scalars.vector_to_blob("embedding")).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.get("v", F.lit(0)).cast("double").alias("first"), F.get("v", F.lit(63)).cast("double").alias("last"))


@query(catalogue._SQL["resolve_decision"].replace("select p.k as key,", "select outcome, count(*) as n from (select p.k as key,") + ") group by outcome")
def outcome_counts(m):
    """AG-28: how a batch was resolved."""
    return matching.outcome_counts(_decisions(m))


@query(catalogue._SQL["resolve_decision"].replace("select p.k as key,", ", d as (select p.k as key,", 1) + """), old as (select cast(p_partkey as varchar) as product_id, case when p_partkey % 6 = 0 then ['ANY||ITEM ' || cast(p_partkey - 1 as varchar), 'ANY||ITEM ' || cast(p_partkey + 1 as varchar)] else [] end as aliases from part),
new as (select product_id, list_sort(list(distinct 'ANY||ITEM ' || cast(key as varchar))) as more, outcome from d where outcome in ('matched', 'created') group by product_id, outcome),
grown as (select product_id, list_sort(list_distinct(list_concat(aliases, coalesce(more, [])))) as aliases from old left join (select * from new where outcome = 'matched') using (product_id) union all select product_id, more from new where outcome = 'created')
select product_id, array_to_string(aliases, ',') as aliases from grown""")
def catalog_growth(m):
    """ER-7, ER-8, SO-4, SF-25: the catalog with a batch's aliases and new products."""
    d, c = _decisions(m), _catalog(m)
    grown = matching.add_created(matching.add_aliases(c, d), d.select("key", "alias", "outcome", "product_id"), _parsed(m))
    return grown.select("product_id", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query("select count(distinct p_partkey) as strings, count(*) filter (p_partkey % 3 = 0) as cached, count(*) filter (p_partkey % 3 <> 0) as new, count(*) filter (p_partkey % 3 = 1) as retried, count(*) filter (p_partkey % 5 = 0) as unidentified from part")
def parse_tallies(m):
    """AG-30, SO-2, JN-10: strings of a run of the parser, known, new, asked twice and not understood."""
    k = F.col("product_id")
    parsed = F.struct(F.when(k % 5 != 0, F.col("raw_description")).alias("product"), F.lit(False).alias("needs_review"), F.when(k % 3 == 1, 2).otherwise(1).alias("attempts"))
    all_ = m.aliases.select("store", "raw_description", parsed.alias("parsed"), k)
    items = m.aliases.select("store", "raw_description").unionByName(m.aliases.select("store", "raw_description"))
    return pages.parse_tallies(items, all_.filter(k % 3 == 0).select("store", "raw_description", "parsed"), all_.drop("product_id"))


@query(None)
def batch_resolution(m):
    """ER-6, AG-28: a catalog built from nothing, every product's string meeting what those before it made of it. No SQL: each decision hangs on all earlier ones; held against a loop in the tests."""
    e = m.spark.read.parquet(f"{m.dir}/embeddings.parquet").select(F.col("vec_id").alias("v"), "embedding")
    n = e.agg(F.max("v")).head()[0] + 1
    k = F.col("p_partkey")
    parts = m.spark.read.parquet(f"{m.dir}/part.parquet").select(
        k.alias("key"), F.concat(F.lit("store "), (k % 7).cast("string")).alias("store"), F.concat(F.lit("ITEM "), F.when(k % 10 == 0, k - k % 70).otherwise(k).cast("string")).alias("raw_description"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("brand"), F.when(k % 11 != 0, F.col("p_name")).alias("product"), F.when(k % 2 == 0, F.col("p_type")).alias("variant"), F.lit(False).alias("needs_review"), (k % n).alias("v"),
    )
    empty = m.spark.createDataFrame([], "product_id string, brand string, product string, variant string, aliases array<string>, embedding array<float>")
    return resolution.resolve_in_order(parts.join(e, "v", "left").drop("v"), empty)[0]
