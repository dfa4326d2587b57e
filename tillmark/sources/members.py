"""Members of large JSON objects and lists, read by as many tasks as a file has splits.

A string of JSON holds no line end, so every line begins outside strings, and all that a line needs to know of those
before it is how deep it stands: a sum over lines, taken within each split and added up over the splits' sums. In a
file that is laid out with a member to a line at least, as indented JSON is, a line at depth one begins a member, and
what lies up to the next such line is its text, joined where a split cuts it. Files laid out in another way are read
whole, each in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.sources.shared import written

_STRING = r'"(?:[^"\\]|\\.)*+"'


def _count(c: Column, kinds: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{kinds}]", ""))


def _running(lines: DataFrame, value: str, name: str) -> DataFrame:
    """``lines`` with the sum of ``value`` over the lines before each in its file: no task holds more than a split."""
    split = lines.groupBy("file", "begin").agg(F.sum(value).alias("_sum"))
    before = split.select("file", "begin", F.coalesce(F.sum("_sum").over(W.partitionBy("file").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("file", "begin").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("_inside", inside).join(before, ["file", "begin"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def members(spark: SparkSession, path: str) -> DataFrame:
    """``file, member`` for each member of the object or list in each file of ``path``: a JSON object of one member, or the element.

    An empty file has no members; a file whose layout does not show them is read whole.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    lines = written(raw.withColumn("at", F.monotonically_increasing_id()), "lines")
    bare = F.regexp_replace(F.regexp_replace("value", _STRING, '""'), r"^\s+|\s+$", "")
    lines = lines.withColumn("bare", bare).withColumn("change", _count(F.col("bare"), r"\[{") - _count(F.col("bare"), r"\]}"))
    lines = _running(lines, "change", "depth")
    flat = F.col("bare")
    for _ in range(4):  # what is nested within the line, from the inside
        flat = F.regexp_replace(flat, r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]", "0")
    closes = F.col("bare").rlike(r"^[}\]]")
    fits = (
        F.when(F.col("depth") == 0, F.col("bare").rlike(r"^([{\[]|\{\}|\[\])?$"))
        .when((F.col("depth") == 1) & closes, F.length("bare") == 1)
        .when(F.col("depth") == 1, ~flat.rlike(r",\s*\S") & F.col("bare").rlike(r'^["\w{\[-]'))
        .when((F.col("depth") == 2) & closes, F.col("bare").rlike(r"^[}\]],?$"))
        .otherwise((F.col("depth") >= 2) & (F.col("depth") + F.col("change") >= 2))
    )
    lines = lines.withColumn("fits", fits | (F.col("bare") == "")).withColumn("starts", ((F.col("depth") == 1) & ~closes & (F.col("bare") != "")).cast("int"))
    lines = written(lines.select("file", "begin", "at", "value", "bare", "depth", "starts", "fits"), "lines")
    files = lines.groupBy("file").agg(F.every("fits").alias("shown"), F.max(F.when((F.col("depth") == 0) & F.col("bare").startswith("{"), True).otherwise(False)).alias("object"))
    odd = [r["file"] for r in files.filter("not shown").select("file").collect()]  # a path for each file of another layout

    numbered = _running(lines.join(files.filter("shown"), "file"), "starts", "_of").withColumn("number", F.col("_of") + F.col("starts"))
    inner = numbered.filter((F.col("number") > 0) & ~((F.col("depth") == 1) & F.col("bare").rlike(r"^[}\]]")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "at", "value"))), lambda x: x["value"]), "\n")
    one = inner.groupBy("file", "number", "object").agg(F.regexp_replace(text, r",\s*$", "").alias("text"))
    found = one.select("file", F.when(F.col("object"), F.concat(F.lit("{"), "text", F.lit("}"))).otherwise(F.col("text")).alias("member"))
    if not odd:
        return found
    whole = spark.read.text(odd, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    as_map = F.transform(F.map_entries(F.from_json("value", "map<string, variant>")), lambda e: F.concat(F.lit("{"), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(e["value"]), F.lit("}")))
    as_list = F.transform(F.from_json("value", "array<variant>"), lambda v: F.to_json(v))
    return found.unionByName(whole.select("file", F.explode(F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_map)).alias("member")))
