"""Named queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions import scalars, units
from tillmark.operators import analysis, matching, pages, storage, validation
from tillmark.plans.model import CHARGED, POINTS, PRINTED, Model, views

V, VC = views(), views(True)
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, by_customer: bool = False):
    """Registers a function of the model as a query, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            m = Model(spark, sf_dir, by_customer)
            m.spark, m.dir = spark, sf_dir
            return f(m)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _points(m: Model) -> DataFrame:
    return analysis.price_points(m.line_items, m.receipts, m.products)


@query(V + """ select shopper_id, coalesce(category, 'unsorted') as category, cast(cents as bigint) as cents, items, cents / sum(cents) over (partition by shopper_id) * 100 as share
from (select shopper_id, category, sum(line_total_cents) as cents, count(*) as items from line_items l join receipts using (receipt_id) left join products p on p.product_id = l.product_id
  where is_voided = 0 and line_total_cents is not null group by shopper_id, category)""")
def spend_by_category(m):
    """Cents, lines and share of each category."""
    return analysis.spend_by_category(m.line_items, m.receipts, m.products).select("shopper_id", "category", "cents", "items", "share")


@query(V + """ select shopper_id, receipt_id, purchase_date as date, merchant_name as store, total_cents as cents, count(line_item_id) as items
from receipts left join (select * from line_items where is_voided = 0) using (receipt_id) group by all""")
def spend_over_time(m):
    """Each visit with its charged lines."""
    return analysis.spend_over_time(m.receipts, m.line_items).drop("spent")


@query(V + POINTS + " select shopper_id, product_id, name, category, receipt_id, purchase_date, store, price, unit from points")
def price_histories_flat(m):
    """Every price point."""
    return _points(m).drop("ord")


@query(V + POINTS + " select shopper_id, product_id, name, category, times_bought, distinct_dates, unit, first_price, latest_price, latest_date, latest_store, cheapest_price, dearest_price, change_percent from changed")
def product_history_summary(m):
    """Each product's history in one row."""
    return analysis.histories(_points(m)).select("shopper_id", "product_id", "name", "category", "times_bought", "distinct_dates", "unit", "first_price", "latest_price", "latest_date", "latest_store", "cheapest_price", "dearest_price", "change_percent")


@query(V + POINTS + " select shopper_id, product_id, name, first_price, latest_price, change_percent from changed where change_percent is not null")
def price_changes(m):
    """Products whose price can be compared over time."""
    return analysis.price_changes(analysis.histories(_points(m))).select("shopper_id", "product_id", "name", "first_price", "latest_price", "change_percent")


@query(V + POINTS + " select shopper_id, product_id, cheapest_store, cheapest_price, dearest_store, dearest_price, (dearest_price - cheapest_price) / cheapest_price * 100 as gap_percent from compared")
def store_comparison(m):
    """Where the same product is cheaper."""
    return analysis.store_comparison(_points(m)).select("shopper_id", "product_id", "cheapest_store", "cheapest_price", "dearest_store", "dearest_price", "gap_percent")


@query(VC + POINTS + """, v as (select shopper_id, count(*) as shops, cast(sum(total_cents) as bigint) as cents, count(distinct purchase_date) as days, min(purchase_date) as first_date, max(purchase_date) as last_date from receipts group by all),
h as (select shopper_id, count(*) as products, count(change_percent) as repeat_products, sum(cast(round_even(change_percent * 1000000, 0) as bigint)) / count(change_percent) / 1000000 as average_change from changed group by all)
select shopper_id, coalesce(shops, 0) as shops, coalesce(cents, 0) / 100 as total_spent, coalesce(cents / 100 / shops, 0) as average_shop, coalesce(products, 0) as products, coalesce(repeat_products, 0) as repeat_products,
  coalesce(days, 0) as days_covered, first_date, last_date, average_change from shoppers left join v using (shopper_id) left join h using (shopper_id)""", by_customer=True)
def shopper_summary(m):
    """The numbers at the top of each page."""
    return analysis.summary(m.shoppers, m.receipts, analysis.histories(_points(m)))


@query(VC + POINTS + """, h as (select shopper_id, count(*) as products, count(change_percent) as changes, max(distinct_dates) as deepest, arg_min(name, (-times_bought, name)) as most from changed group by all),
d as (select shopper_id, count(distinct purchase_date) as dates from points group by all), c as (select shopper_id, count(*) as pairs from compared group by all), v as (select shopper_id, count(*) as visits from receipts group by all),
s as (select shopper_id, coalesce(products, 0) as products, coalesce(changes, 0) as changes, coalesce(deepest, 0) as deepest, most, coalesce(dates, 0) as dates, coalesce(pairs, 0) as pairs, coalesce(visits, 0) as visits
  from shoppers left join h using (shopper_id) left join d using (shopper_id) left join c using (shopper_id) left join v using (shopper_id))
select shopper_id, 1 as rank, 'Buy ' || coalesce(most, 'something') || ' again on a different day' as needs from s where changes = 0
union all select shopper_id, 2, 'Buy the same item at a second store' from s where pairs = 0 and visits > 0
union all select shopper_id, 3, 'Buy something on a different day' from s where dates < 2
union all select shopper_id, 4, 'About 5 regular items priced on two separate store visits' from s where products < 5 or dates < 2
union all select shopper_id, 5, '5 purchases of the same item (best so far: ' || cast(deepest as varchar) || ')' from s where deepest < 5""", by_customer=True)
def unlock_hints(m):
    """What each customer still lacks for an answer."""
    return analysis.unlock_hints(m.shoppers, m.receipts, _points(m)).select("shopper_id", "rank", "needs")


@query(V + " select shopper_id, receipt_id, purchase_date, merchant_name, total_cents, was_deskewed, count(line_item_id) as items from receipts left join line_items using (receipt_id) group by all")
def dashboard_receipts(m):
    """Receipts with all their lines counted."""
    return pages.dashboard_receipts(m.receipts, m.line_items).select("shopper_id", "receipt_id", "purchase_date", "merchant_name", "total_cents", "was_deskewed", "items")


@query(V + " select shopper_id, receipt_id, line_number, canonical_text, category, merchant_name, purchase_date, price_per_display, display_unit, inferred_unit from line_items l join receipts using (receipt_id) join products p on p.product_id = l.product_id where price_per_display is not null")
def dashboard_prices(m):
    """Every priced line, voided ones too."""
    return pages.dashboard_prices(m.line_items, m.receipts, m.products).drop("product_id")


@query(VC + " select shopper_id, cast(coalesce(sum(total_cents), 0) as bigint) as cents from shoppers left join receipts using (shopper_id) group by all", by_customer=True)
def lifetime_spend(m):
    """What each customer spent in all."""
    return pages.lifetime_spend(m.shoppers, m.receipts)


@query(V + " select receipt_id, line_number, raw_description, l.product_id, quantity, line_total_cents, is_voided, canonical_text, category from line_items l left join products p on p.product_id = l.product_id")
def receipt_lines(m):
    """Lines with their products where known."""
    return pages.receipt_lines(m.line_items, m.products).select("receipt_id", "line_number", "raw_description", "product_id", "quantity", "line_total_cents", "is_voided", "canonical_text", "category")


@query(V + " select receipt_id, count(*) as pending from line_items where is_voided = 0 and product_id is null and receipt_id in (select receipt_id from receipts where shopper_id is not null) group by all")
def pending_lines(m):
    """Charged lines without a product."""
    return pages.pending_lines(m.line_items, m.receipts)


@query(V + " select 'line_items' as table_name, count(*) as n from line_items union all select 'products', count(*) from products union all select 'receipts', count(*) from receipts union all select 'shoppers', count(*) from shoppers")
def table_counts(m):
    """Rows of each table."""
    return pages.table_counts(receipts=m.receipts, shoppers=m.shoppers, line_items=m.line_items, products=m.products)


def _checks(m: Model) -> DataFrame:
    return validation.validate(m.printed(), m.line_items)


@query(V + PRINTED + CHARGED + """ select cast(sum(cast(status = 'pass' as int)) as bigint) as passed, cast(sum(cast(status = 'fail' as int)) as bigint) as failed, cast(sum(cast(status = 'uncheckable' as int)) as bigint) as uncheckable,
  round_even(sum(cast(status = 'pass' as int)) * 1000 / sum(cast(status <> 'uncheckable' as int)), 0) / 10 as pass_rate from checks""")
def check_pass_rate(m):
    """How many checks pass of those that run."""
    return pages.check_totals(_checks(m)).select(F.col("pass").alias("passed"), F.col("fail").alias("failed"), "uncheckable", "pass_rate")


@query(V + " select cast(sum(cast(price_per_display is not null as int)) as bigint) as priced, count(*) as lines, sum(cast(price_per_display is not null as int)) * 100 / count(*) as rate from line_items where is_voided = 0")
def priced_rate(m):
    """Charged lines that have a comparable price."""
    return pages.priced_rate(m.line_items).withColumnRenamed("of", "lines")


@query(V + " select cast(sum(cast(needs_review = 0 as int)) as bigint) as parsed, count(*) as strings, sum(cast(needs_review = 0 as int)) * 100 / count(*) as rate from aliases")
def parse_rate(m):
    """Printed strings that were understood."""
    return pages.parse_rate(m.aliases).withColumnRenamed("of", "strings")


@query(V + """, t as (select cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(thinking_tokens) as bigint) as thinking_tokens from receipts)
select *, (prompt_tokens * cast(0.75 as double) + (output_tokens + thinking_tokens) * cast(3.75 as double)) / 1e6 as cost, round_even(thinking_tokens * 100 / (output_tokens + thinking_tokens), 0) as thinking_share from t""")
def token_cost(m):
    """Tokens of all receipts and what they cost."""
    return pages.token_cost(m.receipts)


@query(V + PRINTED + CHARGED + """, n as (select receipt_id, count(*) as lines, sum(cast(product_id is not null as int)) as named from line_items where is_voided = 0 group by all),
k as (select receipt_id, sum(cast(status = 'pass' as int)) as passed, sum(cast(status <> 'uncheckable' as int)) as ran from checks group by all)
select receipt_id, merchant_name, purchase_date, was_deskewed, display_name as who, coalesce(lines, 0) as lines, cast(coalesce(named, 0) as bigint) as named, cast(passed as bigint) as passed, cast(ran as bigint) as ran
from receipts left join shoppers using (shopper_id) left join n using (receipt_id) left join k using (receipt_id)""")
def receipt_quality(m):
    """How well each receipt was read."""
    return pages.receipt_quality(m.receipts, m.shoppers, m.line_items, _checks(m)).drop("extraction_model")


@query(V + " select store, raw_description, count(*) as seen from aliases where needs_review = 1 group by all order by seen desc, store, raw_description limit 40")
def worklist_topk(m):
    """Strings that need review."""
    return pages.worklist(m.aliases)


@query(V + PRINTED + CHARGED + " select receipt_id, check_name, line_number from checks where status = 'fail' order by receipt_id, check_name, coalesce(line_number, 0) limit 30")
def failed_checks(m):
    """The first failed checks."""
    return pages.failed_checks(_checks(m)).select("receipt_id", "check_name", "line_number")


def _check(name: str, column: str):
    sql = V + PRINTED + CHARGED + f" select receipt_id, status, expected_cents, actual_cents, line_number from checks where check_name = '{column}'"

    def f(m):
        return _checks(m).filter(F.col("check_name") == column).select("receipt_id", "status", "expected_cents", "actual_cents", "line_number")

    f.__name__, f.__doc__ = name, f"The check ``{column}`` of every receipt."
    query(sql)(f)


for _n, _c in (
    ("check_items_sum", "items_sum_to_subtotal"), ("check_subtotal_tax", "subtotal_plus_tax_is_total"), ("check_line_arithmetic", "line_arithmetic"),
    ("check_tax_rate", "tax_rate"), ("check_payment", "payment_reconciles"), ("check_item_count", "item_count"),
):
    _check(_n, _c)


@query(V + PRINTED + CHARGED + """ select receipt_id, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'fail') as failed, count(*) filter (status = 'uncheckable') as uncheckable,
  count(*) filter (status = 'fail') = 0 as trustworthy from checks group by all""")
def validation_report(m):
    """Each receipt's verdicts together."""
    return validation.report(_checks(m)).select("receipt_id", "passed", "failed", "uncheckable", "trustworthy")


_FACTOR = "case unit " + " ".join(f"when '{u}' then cast({f!r} as double)" for u, _, f in units.UNITS) + " end"
_PER = "case unit " + " ".join(f"when '{u}' then cast({f!r} as double)" for u, (_, f) in units.SHOWN.items()) + " else cast(1 as double) end"
_SHOWN = "case unit " + " ".join(f"when '{u}' then '{s}'" for u, (s, _) in units.SHOWN.items()) + " end"


@query(V + f""", x as (select receipt_id, line_number, raw_description, product_id, is_voided, line_total, unit_price, size_value, size_unit, case when line_number % 4 = 0 then quantity + 0.25 else quantity end as q from line_items l join products p using (product_id)),
y as (select *, q <> floor(q) as weighed, case when q <> floor(q) then 'lb' else size_unit end as unit from x),
z as (select *, {_FACTOR} as factor, {_PER} as per, {_SHOWN} as shown from y),
w as (select *, case when weighed then unit_price / factor when unit = 'in' or line_total is null then null when unit = 'each' then line_total / (size_value * factor * q) else line_total / (size_value * factor * q) end as price from z)
select receipt_id, line_number, product_id, is_voided, case when unit = 'in' then null when unit in ('lb', 'oz', 'g', 'kg') then 'weight' when unit in ('fl_oz', 'l') then 'volume' else 'count' end as dimension,
  price as price_per_base, case when price is null then null when unit = 'each' then 'each' else shown end as display_unit, case when unit = 'each' then price else price * per end as price_per_display from w""")
def normalize_units(m):
    """Lines priced in a unit that compares; every fourth line is a weighed one."""
    lines = m.line_items.join(m.products, "product_id")
    q = F.when(F.col("line_number") % 4 == 0, F.col("quantity") + 0.25).otherwise(F.col("quantity"))
    n = units.normalize_line(F.col("size_value"), F.col("size_unit"), F.lit(None).cast("int"), F.lit(False), q, F.col("unit_price"), F.col("line_total"), F.lit(None).cast("string"))
    return lines.select("receipt_id", "line_number", "product_id", "is_voided", n.alias("n")).select("receipt_id", "line_number", "product_id", "is_voided", "n.dimension", "n.price_per_base", "n.display_unit", "n.price_per_display")


@query("""with k as (select p_partkey as product_id, p_type as raw, regexp_replace(regexp_replace(replace(lower(trim(p_type || case when p_partkey % 3 = 0 then ' & Co' when p_partkey % 3 = 1 then '/x-y' else '  ' end)), '&', 'and'), '[\\s/\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') as key from part)
select product_id, nullif(trim(key, '_'), '') as category from k""")
def normalize_category(m):
    """Stable keys for categories as proposed."""
    p = F.col("product_id")
    raw = F.concat("p_type", F.when(p % 3 == 0, " & Co").when(p % 3 == 1, "/x-y").otherwise("  "))
    part = m.spark.read.parquet(f"{m.dir}/part.parquet").select(F.col("p_partkey").alias("product_id"), "p_type")
    return part.select("product_id", scalars.normalize_category(raw).alias("category"))


@query("select l_orderkey as receipt_id, l_linenumber as line_number, l_partkey as product_id, cast(round_even(l_extendedprice * 100, 0) as bigint) as cents from lineitem")
def to_cents(m):
    """Dollars as whole cents, halves to even."""
    return m.spark.read.parquet(f"{m.dir}/lineitem.parquet").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"), scalars.to_cents(F.col("l_extendedprice")).alias("cents"))


_FLOOR = 0.30


_NEAR = f"""s as (select q.vec_id as query_id, c.vec_id as product_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))) as sim from embeddings q join embeddings c on q.vec_id <> c.vec_id),
r as (select query_id, product_id, sim, row_number() over (partition by query_id order by sim desc, product_id) as rank from s where sim >= {_FLOOR})"""


def _near(m: Model, floor: float = _FLOOR) -> DataFrame:
    """For every vector the five nearest others, not below the floor."""
    e = m.spark.read.parquet(f"{m.dir}/embeddings.parquet")
    found = matching.candidates(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "product_id"), 6, floor).filter("query_id <> product_id")
    return found.withColumn("rank", F.expr("row_number() over (partition by query_id order by similarity desc, product_id)")).filter("rank <= 5").select("query_id", "product_id", "rank")


@query(f"with {_NEAR} select query_id, product_id, rank from r where rank <= 5 and sim >= {matching.FLOOR}")
def candidates_floor(m):
    """ER-2: the nearest others of every vector, by the rule's own floor."""
    return _near(m, matching.FLOOR)


@query(f"with {_NEAR} select query_id, product_id, rank from r where rank <= 5")
def candidates_topk(m):
    """The nearest others of every vector among all."""
    return _near(m)


_PAIR = "lower(a.p_brand) = lower(b.p_brand)"


@query(f"""with n as (select p_partkey, lead(p_partkey) over (partition by p_size order by p_partkey) as next from part)
select a.p_partkey as a, b.p_partkey as b, case when not {_PAIR} then 'different' when a.p_type <> b.p_type then 'different' when a.p_name = b.p_name then 'same' else 'unsure' end as verdict
from part a join n on n.p_partkey = a.p_partkey join part b on b.p_partkey = n.next""")
def attribute_verdict(m):
    """Verdicts on every product and the next one of its size."""
    p = m.spark.read.parquet(f"{m.dir}/part.parquet").select("p_partkey", "p_size", F.col("p_brand").alias("brand"), F.col("p_type").alias("variant"), F.col("p_name").alias("product"))
    pairs = p.select(F.col("p_partkey").alias("a"), F.struct("brand", "variant", "product").alias("x"), F.expr("lead(struct(p_partkey, brand, variant, product)) over (partition by p_size order by p_partkey)").alias("y")).filter("y is not null")
    pick = lambda s: {c: F.col(f"{s}.{c}") for c in ("brand", "variant", "product")}
    return pairs.select("a", F.col("y.p_partkey").alias("b"), matching.compare_attributes(pick("x"), pick("y")).alias("verdict"))


@query(f"""with {_NEAR},
p as (select p_partkey as k, p_brand as brand, p_type as variant, case when p_partkey % 10 <> 0 then p_name end as product from part),
hit as (select k, min(cast(product_id as varchar)) as product_id from (select p_partkey as product_id, unnest([p_partkey - 1, p_partkey + 1]) as k from part where p_partkey % 6 = 0) group by k),
cand as (select p.k, cast(c.p_partkey as varchar) as product_id, rank, case when lower(p.brand) <> lower(c.p_brand) or lower(p.variant) <> lower(c.p_type) then 'different' when lower(p.product) = lower(c.p_name) then 'same' else 'unsure' end as v
  from p join r on r.query_id + 1 = p.k and rank <= 5 join part c on c.p_partkey = r.product_id + 1 where p.product is not null and p.k not in (select k from hit)),
best as (select k, arg_min(product_id, rank) filter (v = 'same') as s, arg_min(product_id, rank) filter (v = 'unsure') as u from cand group by k)
select p.k as key, case when hit.k is not null then 'matched' when product is null then 'review' when s is not null then 'matched' when u is not null then 'review' else 'created' end as outcome,
  case when hit.k is not null then hit.product_id when product is null then null else coalesce(s, u, substr(sha256(lower(trim(brand)) || '|' || lower(trim(variant)) || '|' || lower(trim(product))), 1, 8)) end as product_id
from p left join hit using (k) left join best using (k)""")
def resolve_decision(m):
    """Every product resolved against the others: known aliases, then the nearest vectors as candidates."""
    return _decisions(m).select("key", "outcome", "product_id")


def _parts(m: Model) -> DataFrame:
    return m.spark.read.parquet(f"{m.dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("variant"), F.col("p_name").alias("product"))


def _catalog(m: Model) -> DataFrame:
    name, k = (lambda k: F.concat(F.lit("ANY||ITEM "), k.cast("string"))), F.col("k")
    return _parts(m).select(k.cast("string").alias("product_id"), "brand", "variant", "product", F.when(k % 6 == 0, F.array(name(k - 1), name(k + 1))).otherwise(F.expr("cast(array() as array<string>)")).alias("aliases"))


def _parsed(m: Model) -> DataFrame:
    return _parts(m).select(F.col("k").alias("key"), F.lit("any").alias("store"), F.concat(F.lit("ITEM "), F.col("k").cast("string")).alias("raw_description"), "brand", "variant", F.when(F.col("k") % 10 != 0, F.col("product")).alias("product"), F.lit(False).alias("needs_review"))


def _decisions(m: Model) -> DataFrame:
    near = _near(m).select((F.col("query_id") + 1).alias("query_id"), (F.col("product_id") + 1).cast("string").alias("product_id"), "rank")
    return matching.resolve(_parsed(m), _catalog(m), near)


@query(V + " select l.receipt_id, l.line_number, l.raw_description, l.quantity, a.product_id from line_items l join receipts r using (receipt_id) left join aliases a on a.store = upper(r.merchant_name) and a.raw_description = l.raw_description")
def alias_lookup(m):
    """Lines with the product that their string at their store is known as."""
    lines = m.line_items.drop("product_id").join(m.receipts.select("receipt_id", "merchant_name"), "receipt_id")
    known = m.aliases.select(scalars.alias_key(F.col("store"), F.col("raw_description")).alias("key"), "product_id")
    return lines.withColumn("key", scalars.alias_key(F.col("merchant_name"), F.col("raw_description"))).join(known, "key", "left").select("receipt_id", "line_number", "raw_description", "quantity", "product_id")


@query(V + """ select receipt_id, shopper_id, source_file, total_cents from receipts where receipt_id % 5 <> 0
union all select receipt_id + 10000000, shopper_id, source_file, total_cents + 1 from receipts where receipt_id % 5 = 0""")
def upsert_replace(m):
    """Every fifth receipt taken in again under the same file: the new row stands, its owner stays."""
    r = m.receipts.select("receipt_id", "shopper_id", "source_file", "total_cents")
    again = r.filter("receipt_id % 5 = 0").select((F.col("receipt_id") + 10_000_000).alias("receipt_id"), F.lit(None).cast("bigint").alias("shopper_id"), "source_file", (F.col("total_cents") + 1).alias("total_cents"))
    return storage.save_receipts(r, again)[0].select("receipt_id", "shopper_id", "source_file", "total_cents")


@query(V + " select receipt_id, line_number, product_id, quantity from line_items where receipt_id % 3 <> 0 or receipt_id not in (select receipt_id from receipts)")
def cascade_delete(m):
    """Lines that are left when every third receipt is deleted."""
    gone = m.receipts.filter("receipt_id % 3 = 0").select("receipt_id")
    return storage.delete_receipts(gone, m.receipts, m.line_items)[1].select("receipt_id", "line_number", "product_id", "quantity")


@query(V + """, k as (select receipt_id, line_number, raw_description, row_number() over (partition by receipt_id order by line_number, raw_description) as i from line_items where is_voided = 0)
, b as (select a.receipt_id, a.i, b.raw_description as other, row_number() over (partition by a.receipt_id, a.i order by b.i) as j from k a join k b on b.receipt_id = a.receipt_id and b.raw_description <> a.raw_description),
s as (select receipt_id, i, count(*) as n, string_agg(other, '|' order by j) as others from b where j <= 20 group by all)
select receipt_id, line_number, raw_description, coalesce(n, 0) as n_siblings, coalesce(others, '') as siblings from k left join s using (receipt_id, i)""")
def sibling_strings(m):
    """The first other strings of its receipt that each line has beside it."""
    return matching.siblings(m.line_items).select("receipt_id", "line_number", "raw_description", F.size("siblings").cast("bigint").alias("n_siblings"), F.array_join("siblings", "|").alias("siblings"))


@query(V + """, c as (select p.product_id, count(distinct upper(r.merchant_name) || '||' || l.raw_description) as aliases from products p join line_items l on l.product_id = p.product_id join receipts r using (receipt_id) group by all)
select aliases, count(*) as n from c where aliases > 1 group by all""")
def multi_alias_counts(m):
    """Products of a catalog with an alias for each store and string that they were bought under, by the number of aliases, where that is over one."""
    seen = m.line_items.select("receipt_id", "product_id", "raw_description").join(m.receipts.select("receipt_id", "merchant_name"), "receipt_id")
    names = seen.groupBy("product_id").agg(F.collect_set(scalars.alias_key(F.col("merchant_name"), F.col("raw_description"))).alias("aliases"))
    catalog = m.products.select("product_id", "canonical_text").join(names, "product_id")
    return matching.multi_alias(catalog).groupBy(F.size("aliases").cast("bigint").alias("aliases")).agg(F.count("*").alias("n"))


@query("""select category from (select distinct p_type as category from part) union select unnest(['produce','dairy','meat','seafood','bakery','pantry','frozen','beverage','snack','household','personal_care','pet','baby'])""")
def vocabulary(m):
    """Known categories and those proposed."""
    from tillmark.sources.readers import read_vocabulary

    return read_vocabulary(m.spark).union(m.products.select(F.coalesce("category", F.lit("PROMO")).alias("category"))).distinct()


@query("""select cast(time_bucket(interval 1 day, ts) as timestamp) as day, user_id % 5 as shopper_id, cast(sum(cast(round_even(value * 100, 0) as bigint)) as bigint) as cents, count(*) as receipts from events group by all""")
def daily_spend(m):
    """The windowed sum of the stream operator, over the whole table at once."""
    from tillmark.streaming.ingest import daily_spend as windowed

    e = m.spark.read.parquet(f"{m.dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("shopper_id"), scalars.to_cents(F.col("value")).alias("total_cents"))
    return windowed(e).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "shopper_id", "cents", "receipts")


def queries() -> dict:
    from tillmark.plans import ledger  # registers its own

    return dict(ledger.REGISTERED[0])


def oracle_sql() -> dict[str, str]:
    from tillmark.plans import ledger

    return dict(ledger.REGISTERED[1])
