"""Entity resolution: retrieve by similarity, decide on attributes.

A batch is decided against one snapshot of the catalog; strings of one batch that name
the same new product get the same id, as it is a digest of what is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.functions.scalars import alias_key, is_identified, strip
from tillmark.operators import nearest

TOP_K, FLOOR = 5, 0.60
SAME, DIFFERENT, UNSURE = "same", "different", "unsure"
#: A catalog below so many vectors is multiplied as one block; larger ones go block by block.
BLOCK_ROWS = 4096


def norm(c: Column) -> Column:
    """Trimmed, lower-cased; blank is null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def compare_attributes(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Verdict on two products by brand, variant and product; size does not count."""
    (ab, av, ap), (bb, bv, bp) = ([norm(x[k]) for k in ("brand", "variant", "product")] for x in (a, b))
    return F.when(ab != bb, DIFFERENT).when(av != bv, DIFFERENT).when(ap == bp, SAME).otherwise(UNSURE)


def candidates(queries: DataFrame, catalog: DataFrame, top_k: int = TOP_K, floor: float = FLOOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, product_id, similarity, rank``: the ``top_k`` nearest of the catalog for each query, not below ``floor``, exactly (see ``nearest``)."""
    found = nearest.nearest(queries, catalog, top_k, floor, block_rows).found
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "product_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def new_product_id(brand: Column, variant: Column, product: Column) -> Column:
    """Eight hex digits that depend on what is compared, so a rerun gives the same."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(norm(x), F.lit("")) for x in (brand, variant, product))), 256), 1, 8)


def resolve(parsed: DataFrame, catalog: DataFrame, similar: DataFrame, adjudicate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, outcome, product_id`` of each parse.

    ``parsed(key, store, raw_description, brand, product, variant, needs_review)``, ``catalog(product_id,
    brand, product, variant, aliases)``, ``similar(query_id, product_id, rank)``. An alias hit is
    ``matched``; what is not identified is ``review``; then candidates in rank order: the first that is the
    same is ``matched``, else the first unsure one ``review``, else ``created`` with a new id.
    ``adjudicate`` turns unsure pairs into verdicts.
    """
    known = catalog.select("product_id", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min("product_id").alias("alias_id"))
    p = parsed.withColumn("alias", alias_key(F.col("store"), F.col("raw_description"))).join(known, "alias", "left")
    open_ = p.filter(F.col("alias_id").isNull() & is_identified(F.struct("product", "needs_review")))
    c = catalog.select("product_id", *(F.col(x).alias(f"c_{x}") for x in ("brand", "product", "variant")))
    pairs = open_.join(similar.withColumnRenamed("query_id", "key"), "key").join(c, "product_id")
    verdict = compare_attributes({x: F.col(x) for x in ("brand", "product", "variant")}, {x: F.col(f"c_{x}") for x in ("brand", "product", "variant")})
    pairs = pairs.withColumn("verdict", verdict)
    if adjudicate:
        sure = pairs.filter(F.col("verdict") != UNSURE)
        pairs = sure.unionByName(adjudicate(pairs.filter(F.col("verdict") == UNSURE)))
    best = pairs.groupBy("key").agg(
        F.min(F.when(F.col("verdict") == SAME, F.struct("rank", "product_id"))).alias("same"), F.min(F.when(F.col("verdict") == UNSURE, F.struct("rank", "product_id"))).alias("unsure")
    )
    out = p.join(best, "key", "left")
    identified = is_identified(F.struct("product", "needs_review"))
    outcome = F.when(F.col("alias_id").isNotNull(), "matched").when(~identified, "review").when(F.col("same").isNotNull(), "matched").when(F.col("unsure").isNotNull(), "review").otherwise("created")
    chosen = F.when(F.col("alias_id").isNotNull(), F.col("alias_id")).when(~identified, F.lit(None)).otherwise(F.coalesce("same.product_id", "unsure.product_id", new_product_id(F.col("brand"), F.col("variant"), F.col("product"))))
    return out.select("key", "alias", outcome.alias("outcome"), chosen.alias("product_id"))


def add_aliases(catalog: DataFrame, decisions: DataFrame) -> DataFrame:
    """Catalog with the aliases of matched decisions, each once."""
    new = decisions.filter(F.col("outcome") == "matched").groupBy("product_id").agg(F.array_sort(F.collect_set("alias")).alias("_new"))
    return catalog.join(new, "product_id", "left").withColumn("aliases", F.when(F.col("_new").isNull(), F.col("aliases")).otherwise(F.array_union("aliases", "_new"))).drop("_new")


def add_created(catalog: DataFrame, decisions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Catalog with one product for each new id, its aliases, and its vector to five decimals."""
    made = decisions.filter(F.col("outcome") == "created").join(parsed, "key")
    fields = [c for c in catalog.columns if c not in ("product_id", "aliases")]
    value = lambda c: F.transform(c, lambda x: F.round(x, 5)) if c == "embedding" else F.col(c)
    first = made.groupBy("product_id").agg(*(F.min_by(value(c) if c in made.columns else F.lit(None), "key").alias(c) for c in fields), F.array_sort(F.collect_set("alias")).alias("aliases"))
    return catalog.unionByName(first.select(*(F.col(f.name).cast(f.dataType) for f in catalog.schema)))


def outcome_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("outcome").agg(F.count("*").alias("n"))


def multi_alias(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.size("aliases") > 1)


def siblings(lines: DataFrame, limit: int = 20) -> DataFrame:
    """Each charged line with the first other descriptions of its receipt."""
    kept = lines.filter(F.col("is_voided") == 0)
    all_ = kept.groupBy("receipt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "raw_description"))), lambda x: x["raw_description"]).alias("_all"))
    return kept.join(all_, "receipt_id").withColumn("siblings", F.slice(F.filter("_all", lambda x: x != F.col("raw_description")), 1, limit)).drop("_all")
