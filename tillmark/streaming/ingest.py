"""Incremental ingest of extracted receipts into a store: the tables of a micro-batch are committed together, once.

A file that comes again, with other contents and in whatever later batch, takes the place of what it was: its receipt
stands once and keeps its owner, its old lines and checks go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillmark.functions.scalars import to_cents
from tillmark.operators.storage import latest, receipt_row
from tillmark.operators.validation import validate
from tillmark.sources.readers import source_file, typed_receipts
from tillmark.sources.schemas import RECEIPT, TABLES, add_missing_columns
from tillmark.sources.store import Store


def receipt_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Receipts as they arrive in folders below ``path``, with ``source_file``, an id that depends on it alone, and when and where they came."""
    reader = spark.readStream.schema(RECEIPT).options(multiLine=True, mode="FAILFAST", pathGlobFilter="*_extracted.json", recursiveFileLookup=True)
    raw = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)
    came = raw.select("*", F.col("_metadata.file_modification_time").alias("came_at"), F.col("_metadata.file_path").alias("came_from"))
    return typed_receipts(came.withColumn("source_file", source_file(F.col("came_from")))).withColumn("receipt_id", F.xxhash64("source_file"))


def tables_of(batch: DataFrame) -> dict[str, DataFrame]:
    """Rows of ``receipts``, ``line_items`` and ``validation_results`` of one batch of receipts; of several of one file the last that came."""
    if "came_at" in batch.columns:
        batch = latest(batch, ["source_file"], [F.desc("came_at"), F.desc("came_from")])
    whole = batch.withColumn("r", F.struct(*[f.name for f in RECEIPT]))
    receipts = whole.select("receipt_id", "source_file", *receipt_row(F.col("r")))
    lines = batch.select("receipt_id", F.posexplode("line_items").alias("at", "x")).select("receipt_id", "at", "x.*")
    rows = lines.select(
        F.xxhash64("receipt_id", "at").alias("line_item_id"), "receipt_id", "line_number", "raw_description", "quantity", to_cents(F.col("unit_price")).alias("unit_price_cents"),
        to_cents(F.col("line_total")).alias("line_total_cents"), to_cents(F.col("discount")).alias("discount_cents"), "tax_flag", F.col("is_voided").cast("int").alias("is_voided"),
    )
    checks = validate(batch.drop("line_items"), lines)
    return {"receipts": add_missing_columns(receipts, TABLES["receipts"]), "line_items": add_missing_columns(rows, TABLES["line_items"]), "validation_results": add_missing_columns(checks, TABLES["validation_results"])}


def save_batch(store: Store, batch: DataFrame, number: int, stream: str = "receipts") -> int | None:
    """Commits the tables of one micro-batch, unless the store holds that number of the stream already. Returns the version.

    The store's manifest carries the number, so the rows and the note that they are in become visible in one step: a
    batch that is run again after a failure either finds itself committed or finds nothing of itself.
    """
    tx = store.begin()
    if tx.base.batches.get(stream, -1) >= number:
        return None
    tables = tables_of(batch)
    try:
        tx.save_receipts(tables["receipts"], tables["line_items"], tables["validation_results"])
        return tx.commit((stream, number))
    finally:
        tx.close()


def ingest(spark: SparkSession, inbox: str, store: Store, checkpoint: str, stream: str = "receipts", files_per_batch: int | None = None) -> StreamingQuery:
    """Takes what is new below ``inbox`` into the store and stops."""
    source = receipt_stream(spark, inbox, files_per_batch)
    return source.writeStream.foreachBatch(lambda batch, number: save_batch(store, batch, number, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_spend(points: DataFrame, delay: str = "2 days") -> DataFrame:
    """Cents and receipts for each shopper and day of a stream of ``ts, shopper_id, total_cents``, late ones up to ``delay``."""
    return points.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "shopper_id").agg(F.sum("total_cents").alias("cents"), F.count("*").alias("receipts"))
