"""Resolution of a batch in order: each string meets what the strings before it have made of the catalog.

One after another, a string is matched, put to review, or becomes a product that later ones can be matched with; and
what is matched or created leaves an alias behind. Only strings whose vectors are joined by pairs not below the floor can
meet, so the vectors fall into parts, found once by one search of the different vectors. A part's strings are read in order
and decided one by one, a part in one task, all parts at once.

What that leaves is decided in rounds: strings of parts where an alias stands twice, where verdicts are asked for, or of
more than ``SLAB`` strings, whose slabs are read at once and find what came before their slab by a search. All of these are
decided against a guess of what the others give, then again against what that gave, until nothing changes. A decision
depends on earlier strings only, so that what no longer changes is what the one-by-one loop gives, whatever the first guess
was: after ``n`` rounds at least all strings are right that hang on no more than ``n`` others of other slabs in a row. The first
guess, that the earliest string of each brand, variant and product in a part creates it, makes it a few rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.functions.scalars import alias_key, is_identified
from tillmark.operators.matching import DIFFERENT, FLOOR, SAME, TOP_K, UNSURE, norm
from tillmark.operators.nearest import SLACK, linked, nearest
from tillmark.sources.shared import dropped, free_shuffles, written

FIELDS = ("brand", "variant", "product")
#: Strings and catalog entries that are read in order as one.
SLAB = 1 << 15
#: Hashes that are tried until no two vectors share one.
SEEDS = 8


def batch_product_id(alias: Column) -> Column:
    """Sixteen hex digits that depend on the alias that creates the product."""
    return F.substring(F.sha2(alias.cast("binary"), 256), 1, 16)


def vector_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "embedding")


def _vectors(asking: DataFrame, catalog: DataFrame, made: list[str]) -> tuple[DataFrame, Column]:
    """``vec, embedding``: each different vector once, and its hash ``vec``, which no other one has."""
    both = asking.select("embedding").unionByName(catalog.select("embedding")).filter("embedding is not null")
    for seed in range(SEEDS):
        mine: list[str] = []
        one, other = F.min("embedding"), F.max("embedding")
        table = written(both.groupBy(vector_hash(seed).alias("vec")).agg(one.alias("embedding"), (one != other).alias("shared")), "vectors", mine)
        if table.filter("shared").isEmpty():
            made += mine
            return table.drop("shared"), F.when(F.col("embedding").isNotNull(), vector_hash(seed))
        dropped(asking.sparkSession, mine)
    raise RuntimeError(f"different vectors share a hash with each of {SEEDS} seeds")


def _parts(vectors: DataFrame, floor: float, block_rows: int, made: list[str]) -> DataFrame:
    """``vec, part`` of all that is joined with another one, ``part`` being one of them: joined ones become one, until no pair is left."""
    spark = vectors.sparkSession
    found = linked(vectors.withColumnRenamed("vec", "id"), floor, block_rows)
    tables: list[str] = []
    pairs = written(found.found.select(F.col("query_id").alias("a"), F.col("product_id").alias("b")), "links", tables)
    dropped(spark, found.tables)
    parts = written(pairs.select(F.explode(F.array("a", "b")).alias("vec")).distinct().withColumn("part", F.col("vec")), "parts", tables)
    while not pairs.isEmpty():
        mine: list[str] = []
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "least", mine)
        parts = written(parts.join(least, parts["part"] == least["a"], "left").select("vec", F.coalesce("to", "part").alias("part")), "parts", mine)
        pairs = pairs.join(least, "a").select(F.col("to").alias("a"), F.col("b").alias("c")).join(least.withColumnRenamed("a", "c").withColumnRenamed("to", "b"), "c")
        pairs = written(pairs.filter("a <> b").select("a", "b").distinct(), "links", mine)
        dropped(spark, tables)
        tables = mine
    made += tables
    return parts


class _There:
    """The vectors of a part, and for each the ``k`` first entries that are there by now."""

    def __init__(self, k: int, floor: float) -> None:
        self.k, self.floor = k, floor
        self.index: dict[int, int] = {}
        self.vectors: list[np.ndarray] = []
        self.matrix: np.ndarray | None = None
        self.entries: list[list[tuple]] = []

    def add(self, vec: int, vector: list[float]) -> None:
        self.index[vec] = len(self.vectors)
        self.vectors.append(np.array(vector, np.float32).astype(np.float64))
        self.entries.append([])

    def put(self, vec: int, entry: tuple) -> None:
        here = self.entries[self.index[vec]]
        here.append(entry)
        if len(here) > self.k:
            here.sort(key=lambda e: e[0])
            here.pop()

    def nearest(self, vec: int, before: list[tuple]) -> list[tuple]:
        """The ``k`` nearest entries, of these or ``before``, nearest first and equal ones by name, as ``(-similarity, *entry)``."""
        if self.matrix is None:
            self.matrix = np.stack(self.vectors)
        me = self.matrix[self.index[vec]]
        near = np.flatnonzero(self.matrix @ me >= self.floor - SLACK)
        near = near[[bool(self.entries[n]) for n in near]] if len(near) else near
        exact = (self.matrix[near] * me).sum(axis=1)
        least = max(self.floor, np.partition(exact, -self.k)[-self.k]) if len(near) > self.k else self.floor
        found = before + [(-s, *e) for n, s in zip(near, exact.tolist(), strict=True) if s >= least for e in self.entries[n]]
        return sorted(found, key=lambda e: e[:2])[: self.k]


def _verdict(a: tuple, b: tuple) -> str:
    """``matching.compare_attributes`` of what ``norm`` gives."""
    if any(x is not None and y is not None and x != y for x, y in zip(a[:2], b[:2], strict=True)):
        return DIFFERENT
    return SAME if a[2] is not None and a[2] == b[2] else UNSURE


def _read_in_order(rows: DataFrame, k: int, floor: float) -> DataFrame:
    """Decides the strings of each part and slab one after another.

    ``rows(part, slab, at, vec, embedding, named, like, hit, before, said, ...)``: first the part's vectors (``at`` -2, with ``embedding``),
    then entries of the catalog (-1), then strings; ``named`` is the id that it has or gets, ``like`` its brand, variant and product as
    they are compared, ``hit`` the product of an earlier alias, ``before`` what an earlier slab has for it, ``said`` verdicts on entries.
    Strings come back with ``outcome, product_id`` and ``unsure``, the ranks and entries that attributes do not decide.
    """
    out = rows.select(*(c for c in rows.columns if c not in ("embedding", "before", "said")), F.lit("").alias("outcome"), F.lit("").alias("product_id"), F.expr("cast(null as array<struct<rank: int, entry: string>>)").alias("unsure"))

    names, schema = out.columns, out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, there = None, _There(k, floor)
        for batch in batches:
            part, slab, at, vec, embedding, named, like, hit, before, said = (batch.column(c).to_pylist() for c in ("part", "slab", "at", "vec", "embedding", "named", "like", "hit", "before", "said"))
            outcome, to, unsure = [], [], []
            for n, i in enumerate(at):
                if (part[n], slab[n]) != group:
                    group, there = (part[n], slab[n]), _There(k, floor)
                if i == -2:
                    there.add(vec[n], embedding[n])
                    continue
                me = tuple(like[n])
                entry = (f"{named[n]}#{i}", named[n], *me)
                if i == -1:
                    there.put(vec[n], entry)
                    continue
                asks: list[dict] = []
                if hit[n] is not None:
                    what, which = "matched", hit[n]
                else:
                    known = {s["entry"]: s["said"] for s in said[n] or []}
                    first: dict[str, str] = {}
                    for rank, (_, name, other, *its) in enumerate(there.nearest(vec[n], [(b["far"], b["entry"], b["other_id"], *b["like"]) for b in before[n] or []])):
                        verdict = _verdict(me, its)
                        if verdict == UNSURE:
                            asks.append({"rank": rank, "entry": name})
                            verdict = known.get(name, UNSURE)
                        first.setdefault(verdict, other)
                    what = "matched" if SAME in first else "review" if UNSURE in first else "created"
                    which = first.get(SAME, first.get(UNSURE, named[n]))
                if what == "created":
                    there.put(vec[n], entry)
                outcome.append(what)
                to.append(which)
                unsure.append(asks)
            strings = batch.filter(pa.array([i >= 0 for i in at]))
            new = {"outcome": pa.array(outcome, pa.string()), "product_id": pa.array(to, pa.string()), "unsure": pa.array(unsure, pa.list_(pa.struct([("rank", pa.int32()), ("entry", pa.string())])))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else strings.column(c) for c in names], names)

    dealt = rows.repartition("part", "slab").sortWithinPartitions("part", "slab", "at")
    return dealt.mapInArrow(run, schema)


def resolve_in_order(
    parsed: DataFrame, catalog: DataFrame, adjudicate: Callable[[DataFrame], DataFrame] | None = None, top_k: int = TOP_K, floor: float = FLOOR, block_rows: int = 4096, max_rounds: int = 60
) -> tuple[DataFrame, int]:
    """``key, alias, outcome, product_id`` of each parse, and the number of rounds.

    ``parsed(key long, store, raw_description, brand, product, variant, needs_review, embedding)`` is in the order of
    ``key``, which is unique and not negative; ``catalog(product_id, brand, product, variant, aliases, embedding)``. An
    alias of the catalog, or that an earlier string left, is ``matched``. What is not identified is ``review``. Then
    the ``top_k`` nearest of what is there by then, not below ``floor``, in the order of likeness (equal ones by id):
    the first that is the same is ``matched``, else the first unsure one ``review``, else the string is ``created``.
    ``adjudicate`` turns unsure pairs into verdicts; it is asked once for each pair of strings, whatever the rounds.

    If decisions have not settled after ``max_rounds``, this raises ``RuntimeError``.
    """
    spark = parsed.sparkSession
    wide: list[str] = []
    kept: list[str] = []  # tables that all rounds read
    like = F.array(*(norm(F.col(c)) for c in FIELDS)).alias("like")
    catalog = catalog.withColumn("embedding", F.col("embedding").cast("array<float>"))
    known = catalog.select("product_id", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min("product_id").alias("alias_id"))
    items = parsed.withColumns({"alias": alias_key(F.col("store"), F.col("raw_description")), "identified": is_identified(F.struct("product", "needs_review"))}).join(known, "alias", "left")
    items = written(items.select(F.col("key").cast("long").alias("at"), "alias", "alias_id", "identified", *FIELDS, F.col("embedding").cast("array<float>").alias("embedding")), "parsed", wide)
    vectors, vec = _vectors(items.filter("alias_id is null and identified"), catalog, kept)
    items = written(items.withColumn("vec", vec).drop("embedding").withColumn("shared", F.count("*").over(W.partitionBy("alias")) > 1), "strings")
    dropped(spark, wide)

    parts = _parts(vectors, floor, block_rows, kept)
    placed = lambda rows: rows.join(parts, "vec", "left").withColumn("part", F.coalesce("part", "vec"))
    asks = "alias_id is null and identified and vec is not null"
    here = written(placed(catalog.withColumn("vec", vec).filter("vec is not null").select("vec", F.lit(-1).cast("long").alias("at"), F.col("product_id").alias("named"), like)), "here", kept)
    asking = placed(items.filter(asks)).select("part", "at", "vec", "alias", "shared", batch_product_id(F.col("alias")).alias("named"), like, *(FIELDS if adjudicate else ()))
    of_part = asking.select("part", "shared", F.lit(1).alias("n")).unionByName(here.select("part", F.lit(False).alias("shared"), F.lit(1).alias("n"))).groupBy("part").agg(F.sum("n").alias("n"), F.max("shared").alias("rounds"))
    of_part = written(of_part.select("part", (F.col("n") > SLAB).alias("large"), (F.col("rounds") | (F.col("n") > SLAB) | F.lit(bool(adjudicate))).alias("rounds")).filter("rounds"), "rounds", kept)
    large_parts = of_part.filter("large").select("part")
    asking = asking.join(of_part, "part", "left").fillna(False, ["large", "rounds"])

    def read_in_order(strings: DataFrame) -> DataFrame:
        """What the strings of some parts give, by ``_read_in_order``."""
        to_read = strings.select("part", "slab", "vec").distinct()
        entries = here.join(large_parts, "part", "left_anti").join(to_read.select("part", "slab").distinct(), "part", "left_semi").withColumn("slab", F.lit(0).cast("long"))
        its = to_read.unionByName(entries.select("part", "slab", "vec")).distinct().join(vectors, "vec").withColumn("at", F.lit(-2).cast("long"))
        strings = strings.withColumns({c: F.expr(f"cast(null as {t})") for c, t in (("hit", "string"), ("before", "array<struct<far: double, entry: string, other_id: string, like: array<string>>>"), ("said", "array<struct<entry: string, said: string>>")) if c not in strings.columns})
        return _read_in_order(strings.unionByName(entries, allowMissingColumns=True).unionByName(its, allowMissingColumns=True), top_k, floor)

    same = F.lit(0).cast("long").alias("slab")
    done = read_in_order(asking.filter("not rounds").select("part", same, "at", "vec", "alias", "named", "like")).select("at", "alias", "outcome", "product_id")
    plain = items.filter(f"alias_id is null and not shared and not ({asks})")
    done = written(done.unionByName(plain.select("at", "alias", F.when(F.col("identified"), "created").otherwise("review").alias("outcome"), F.when(F.col("identified"), batch_product_id(F.col("alias"))).alias("product_id"))), "done", kept)
    free_shuffles(spark)

    # Strings that are decided in rounds; those of large parts in slabs.
    slab = F.row_number().over(W.partitionBy("part").orderBy("at")) - 1
    cut = asking.filter("large").withColumn("slab", F.floor(slab / F.lit(SLAB))).withColumn("start", F.min("at").over(W.partitionBy("part", "slab")))
    again = cut.unionByName(asking.filter("rounds and not large").withColumns({"slab": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})).drop("rounds")
    first = F.min("at").over(W.partitionBy("part", "like"))
    again = again.withColumn("outcome", F.when(F.col("at") == first, "created")).withColumn("asks", F.lit(True))
    rest = items.filter(f"alias_id is null and shared and not ({asks})").select("at", "alias", "shared", batch_product_id(F.col("alias")).alias("named"), "identified", F.lit(False).alias("asks"))
    state = again.unionByName(rest, allowMissingColumns=True).withColumn("product_id", F.when(F.col("outcome") == "created", F.col("named")))
    columns = state.columns
    judged: DataFrame | None = None
    asked_more, verdicts = False, []
    seen, rounds = None, 0
    tables: list[str] = []  # of the round before, and its decisions
    while True:
        mine: list[str] = []
        state = written(state.select(*columns), "decisions", mine)
        dropped(spark, tables)
        free_shuffles(spark)
        sign = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("at", "outcome", "product_id").cast("decimal(38,0)"))).head())
        if sign == seen and not asked_more:
            break
        if rounds == max_rounds:
            raise RuntimeError(f"decisions did not settle in {max_rounds} rounds")
        seen, rounds, tables = sign, rounds + 1, mine
        if not sign[0]:
            continue
        # The alias that the earliest string which was not put to review leaves; unidentified ones never leave any.
        left = state.filter("shared and (asks or identified) and outcome <> 'review'").groupBy("alias").agg(F.min(F.struct("at", "product_id")).alias("by"))
        old = state.filter("not shared").unionByName(state.filter("shared").join(left, "alias", "left"), allowMissingColumns=True)
        old = old.withColumn("hit", F.when(F.col("by.at") < F.col("at"), F.col("by.product_id"))).drop("by", "outcome", "product_id")
        strings = old.filter("asks")
        entry = F.concat("named", F.lit("#"), F.col("at").cast("string")).alias("entry")
        large = state.filter("large")
        if not large.isEmpty():
            made = state.filter("large and outcome = 'created'").select("vec", "at", entry, F.col("named").alias("other_id"), "like")
            made = made.unionByName(here.join(large_parts, "part", "left_semi").select("vec", "at", entry, F.col("named").alias("other_id"), "like"))
            found = nearest(large.join(vectors, "vec").select(F.col("at").alias("query_id"), F.col("start").alias("at"), "embedding"), made.join(vectors, "vec").select(F.col("entry").alias("product_id"), "at", "embedding"), top_k, floor, block_rows, ordered=True)
            tables += found.tables
            rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "product_id"))
            near = found.found.withColumn("rank", rank).filter(F.col("rank") <= top_k).withColumnRenamed("product_id", "entry").join(made.select("entry", "other_id", "like"), "entry")
            near = near.groupBy(F.col("query_id").alias("at")).agg(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "entry", "other_id", "like")).alias("before"))
            strings = strings.join(near, "at", "left")
        if judged is not None:
            strings = strings.join(judged.groupBy("at").agg(F.collect_list(F.struct("entry", "said")).alias("said")), "at", "left")
        read = read_in_order(strings)
        if adjudicate:
            read = written(read, "read", tables)
            made = read.filter("outcome = 'created'").select(entry, "named", *FIELDS).unionByName(catalog.select(F.concat("product_id", F.lit("#-1")).alias("entry"), F.col("product_id").alias("named"), *FIELDS))
            pairs = read.select("at", *FIELDS, F.explode("unsure").alias("u")).select("at", *FIELDS, "u.*").join(made.select("entry", F.col("named").alias("other_id"), *(F.col(c).alias(f"c_{c}") for c in FIELDS)), "entry")
            new = written(pairs if judged is None else pairs.join(judged, ["at", "entry"], "left_anti"), "pairs", tables).withColumn("verdict", F.lit(UNSURE))
            asked_more = not new.isEmpty()
            said = adjudicate(new).select("at", "entry", F.col("verdict").alias("said"))
            tables += verdicts
            verdicts = []
            judged = written(said if judged is None else judged.unionByName(said), "verdicts", verdicts)
        others = old.filter("not asks").withColumn("outcome", F.when(F.col("hit").isNotNull(), "matched").when(F.col("identified"), "created").otherwise("review"))
        others = others.withColumn("product_id", F.coalesce("hit", F.when(F.col("identified"), F.col("named"))))
        state = read.select(*(c for c in columns if c in read.columns)).unionByName(others.select(*columns), allowMissingColumns=True)
    done = written(done.unionByName(state.select("at", "alias", "outcome", "product_id")), "decisions")
    dropped(spark, mine + verdicts + kept)
    settled = items.filter("alias_id is not null").select("at", "alias", F.lit("matched").alias("outcome"), F.col("alias_id").alias("product_id"))
    return settled.unionByName(done).withColumnRenamed("at", "key"), rounds
