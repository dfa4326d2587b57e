"""Shared pieces of the text operators: shared work folder, written tables, Arrow maps, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tillmark-"))
    return _own_dir[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and where: cuts lineage, survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/tillmark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are done with; it acts when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bounds of the batches that Python workers get: whole rows, so a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def _give_back() -> None:
    """Returns memory that a worker no longer uses to the system; idle workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(f, schema)`` on batches of bounded size, whose workers give memory back at the end of a task."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", conf.get(key)) or 0) if conf.get(key).lstrip("-").rstrip("bB").isdigit() else 0
        if not 0 < now <= most:
            conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` where ``f`` turns one record batch into a dict of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = f(batch)
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return arrow_map(df, run, schema)


def by_group(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups of one ``key`` from batches sorted by it: small groups together, up to about ``rows`` rows, a larger one alone."""
    held: list[pa.RecordBatch] = []
    n = 0

    def columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in parts[0].schema.names}

    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:  # all but the last group can go
            k = batch.column(key).to_numpy(zero_copy_only=False)
            last = held[-1].column(key)[-1].as_py()
            end = int(np.searchsorted(k, last, side="right"))
            held.append(batch.slice(0, end))
            n += end
            if end == batch.num_rows:
                continue
            yield columns(held)
            held, n, batch = [], 0, batch.slice(end)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield columns(held)


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


#: A key with more than one in so many rows is joined by broadcast: there are fewer such keys than this.
HEAVY = 200


def join_heavy(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each of their keys and in ``count`` how many rows have it.

    Keys with over 1 in ``HEAVY`` of all rows are fewer than ``HEAVY``, so their part of ``table`` is broadcast and
    their rows stay where they are; the others are shuffled, and none of them is large.
    """
    total = table.agg(F.sum(count)).head()[0] or 0
    is_heavy = F.col(count) * HEAVY > total
    heavy = F.broadcast(table.filter(is_heavy).drop(count))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.filter(~is_heavy).drop(count), key)
    return rows.join(heavy, key).unionByName(light)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that is no column of ``df``, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}" if k else name).lower() not in taken)


def lower_ascii(c: Column) -> Column:
    """``c`` with A-Z lower-cased and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` of longs by alternating large-star and small-star rounds.

    Returns ``node, root`` for every node that has an edge; ``root`` is the
    smallest node id reachable. Hubs are pre-aggregated before they are joined,
    each round is written to the shared folder, and nothing is collected but
    a count and a checksum.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now, at = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    before = sign(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after, new_at = written(star(star(now, True), False), tag)
        drop_path(spark, at)
        now, at, seen = after, new_at, sign(after)
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
