"""Readers of extracted receipts, caches, catalogs, vocabularies and photographs; writers of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.jpeg import header, mirrored, turn
from tillmark.functions.scalars import SEED_CATEGORIES
from tillmark.sources.members import members
from tillmark.sources.schemas import PARSED, RECEIPT

#: Limits of a photograph: bytes, and pixels of the shorter side.
LEAST_BYTES, MOST_BYTES, SHORT_SIDE = 1024, 25 * 1024 * 1024, 600
EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif")


def source_file(path: Column) -> Column:
    """``x.jpg`` from ``.../x_extracted.json``."""
    return F.concat(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(_extracted)?\.json$", ""), F.lit(".jpg"))


def typed_receipts(raw: DataFrame) -> DataFrame:
    """Receipts as typed rows; a missing list of lines, or a line without number or description, is an error."""
    lines = F.coalesce("line_items", F.raise_error(F.lit("receipt without line_items")))
    lines = F.transform(
        lines,
        lambda x: x.withField(
            "raw_description", F.coalesce(x["raw_description"], F.raise_error(F.lit("line without raw_description")))
        ).withField("line_number", F.coalesce(x["line_number"], F.raise_error(F.lit("line without line_number")))).withField("is_voided", F.coalesce(x["is_voided"], F.lit(False))),
    )
    return raw.withColumn("line_items", lines).withColumn("currency", F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")))


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*_extracted.json`` below ``path`` with the file it came from, bad files failing loudly."""
    raw = spark.read.schema(RECEIPT).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*_extracted.json").json(path)
    return typed_receipts(raw.withColumn("source_file", source_file(F.input_file_name())))


def read_parse_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of parses by ``STORE||description`` as rows ``store, raw_description, parsed``; a large file is read by many tasks."""
    parsed = F.from_json("member", f"map<string, {PARSED.simpleString()}>")
    rows = members(spark, path).select(F.explode(parsed).alias("key", "parsed"))
    return rows.select(F.substring_index("key", "||", 1).alias("store"), F.regexp_replace("key", r"^[^|]*\|\|", "").alias("raw_description"), "parsed")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object or list of catalog products; a large file is read by many tasks."""
    product = "struct<product_id: string, canonical_text: string, product: string, brand: string, variant: string, category: string, embedding: array<float>, aliases: array<string>>"
    found = members(spark, path).select("member", F.from_json("member", product).alias("p"), F.from_json("member", f"map<string, {product}>").alias("m"))
    # an element of a list is a product; a member of an object has its id for its key
    own = F.get_json_object("member", "$.product_id").isNotNull()
    return found.select(F.when(own, F.col("p")).otherwise(F.get(F.map_values("m"), 0)).alias("x")).select("x.*")


def read_vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The known categories: the seeds and those stored."""
    seeds = spark.createDataFrame([(c,) for c in SEED_CATEGORIES], "category string")
    if path is None:
        return seeds
    stored = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("category"))
    return seeds.union(stored).distinct()


def capture(spark: SparkSession, path: str) -> DataFrame:
    """Photographs with the first rule that each breaks (null: none), in the order in which they are tested.

    The headers of PNG and JPEG give the size, and EXIF how far a photograph is to be turned clockwise (``turn``) and
    whether it is mirrored then; a JPEG without size, or whose data does not end, is no image. Other formats need a
    decoder. Spark's source does not list files of no bytes, so those are not rows here.
    """
    f = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    png = F.substring("content", 1, 8) == F.lit(bytes([137, 80, 78, 71, 13, 10, 26, 10]))
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    jpeg = F.substring("content", 1, 3) == F.lit(bytes([255, 216, 255]))
    is_jpeg = ext.isin("jpg", "jpeg") & jpeg
    f = f.withColumn("head", F.when(is_jpeg & (F.col("length") <= MOST_BYTES), header(F.col("content"))))
    head = F.col("head")
    side = F.when(png, F.least(number(17), number(21))).otherwise(F.least(head["width"], head["height"]))
    broken = (
        F.when(~ext.isin(*EXTENSIONS), "unsupported type")
        .when(F.col("length") < LEAST_BYTES, "file too small")
        .when(F.col("length") > MOST_BYTES, "file too large")
        .when(ext.isin("png") & ~png | ext.isin("jpg", "jpeg") & (~jpeg | F.coalesce(head["width"] * head["height"], F.lit(0)).eqNullSafe(0) | ~head["whole"]), "not an image")
        .when(side < SHORT_SIDE, "image too small")
    )
    return f.select("path", "length", ext.alias("extension"), side.alias("short_side"), turn(head["orientation"]).alias("turn"), F.coalesce(mirrored(head["orientation"]), F.lit(False)).alias("mirrored"), broken.alias("rejected"))


def write_table(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Rows into the Parquet table below ``root``."""
    df.write.mode(mode).parquet(f"{root}/{table}")


def write_vocabulary(df: DataFrame, path: str) -> None:
    """Known categories, sorted, as one JSON list; a vocabulary is a few hundred words."""
    one = df.agg(F.array_sort(F.collect_set("category")).alias("v")).select(F.to_json("v").alias("value"))
    one.write.mode("overwrite").text(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """The catalog as Parquet, in place of what was there."""
    df.write.mode("overwrite").parquet(path)
