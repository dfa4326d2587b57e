"""Fill-in-the-middle: texts cut at line ends and rearranged around sentinels, all in Spark SQL expressions.

``regexp_extract_all`` makes a text's array of lines, four groups of hex digits of a digest of the seed and the id
give the cuts and the form, ``slice`` and ``array_join`` build the parts. Nothing is shuffled: each row is a
function of its id and its text, so a lost task gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or a last line without.
LINES = r"[^\n]*\n|[^\n]+"


def _draw(digest: Column, k: int) -> Column:
    """The ``k``-th group of eight hex digits, counted from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, text, output`` for each row of ``docs``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: texts that are empty,
    hold a sentinel, or fall outside ``fim_percent``. ``n`` counts lines, the lengths count code points. A null text is
    empty. A null id draws from the digest of the seed alone, as if it were written ''. Rows with one id share their
    draws, not their cuts; repeated rows give repeated results, an empty table none; other columns are left out,
    whatever their names. A text of any length is one array of lines in its task.
    """
    p, s, m = sentinels
    has = lambda c: F.col("text").contains(F.lit(c))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256))
        .withColumn("units", F.regexp_extract_all("text", F.lit(LINES), F.lit(0)))
        .withColumn("n", F.size("units").cast("long"))
    )
    cut = lambda k: (_draw(F.col("digest"), k) % (F.col("n") + 1)).cast("int")
    rows = rows.withColumn("low", F.least(cut(0), cut(1))).withColumn("high", F.greatest(cut(0), cut(1)))
    plain = (F.col("text") == "") | has(p) | has(s) | has(m) | (_draw(F.col("digest"), 2) % 100 >= fim_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm"))
    part = lambda begin, length: F.array_join(F.slice("units", begin, length), "")
    shaped = F.col("form") != "plain"
    rows = (
        rows.withColumn("prefix", F.when(shaped, part(F.lit(1), F.col("low"))))
        .withColumn("middle", F.when(shaped, part(F.col("low") + 1, F.col("high") - F.col("low"))))
        .withColumn("suffix", F.when(shaped, part(F.col("high") + 1, F.col("n").cast("int") - F.col("high"))))
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select(
        F.col("id").alias(id_col), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "text", output.alias("output")
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made from, read from its sentinels and the form alone; null for an output without them.

    No part holds a sentinel, and none can arise where a part meets one, as no sentinel begins as another one ends;
    so the first place of each sentinel is the place where it was put.
    """
    p, s, m = sentinels
    after = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle = after(output, m)
    head = before(output, m)
    psm = F.concat(after(before(head, s), p), middle, after(head, s))
    spm = F.concat(after(head, p), middle, after(before(head, p), s))
    marked = output.contains(F.lit(p)) & output.contains(F.lit(s)) & output.contains(F.lit(m))
    return F.when(form == "plain", output).when(marked & (form == "psm"), psm).when(marked & (form == "spm"), spm)
