"""URL filter: fixed rules, and for the rest a path-template tree of each host.

Column expressions and joins only. Each path segment becomes a literal or a
wildcard by its form; what is left is counted once for each (host, template),
and all further work is on that table, from the root of each host down, whatever the
depth. Below a node, segments become ``*`` where they are many and rare. Branches are put in the
order of their labelled purity and neighbours that a two-sample test does not tell apart merge:
from there on they are one node with one subtree. Its purity is smoothed towards its parent's. A
branch without siblings is its parent; such chains are taken in one step. Labels are the
verdicts of the rules themselves on the URLs that they decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.llm.common import drop_path, written

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Children of a node from which on rare ones are variable, and the mean count below which they are rare.
MANY, RARE = 20, 3.0
#: Weight of the parent's purity, in labelled URLs; share of blocked ones from which on a branch is rejected; two-sided 5 % of the normal law.
PRIOR, REJECT, Z = 5.0, 0.6, 1.96
SALTS = 16


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def segment_forms(path: Column) -> Column:
    """Path segments with those of variable form as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    form = lambda s: (
        F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), "<n>")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), "<date>")
        .when(s.rlike(r"^(?i)[0-9a-f-]{16,}$"), "<hex>")
        .when(s.rlike(r"^[^-_]+([-_][^-_]+){2,}$") | (F.length(s) > 40), "<slug>")
        .when(s.rlike(r"[0-9]{3,}"), "<id>")
        .otherwise(s)
    )
    return F.transform(parts, form)


def _salted(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``left`` joined to the few columns of ``right``, whose rows are repeated under salts: a host may have a third of ``left``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(right.select("*", salts), [*keys, "salt"], how).drop("salt")


def _smooth(b: Column, a: Column, prior: Column) -> Column:
    return (b + F.lit(PRIOR) * prior) / (b + a + F.lit(PRIOR))


def _along(t: DataFrame) -> DataFrame:
    """Open templates moved down along the segments that all below their node share."""
    rest = F.slice("segs", F.col("d") + 1, F.size("segs"))
    shared = t.groupBy("host", "node").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    at = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
    shared = shared.select("host", "node", F.when(at == 0, F.size("lo")).otherwise(at - 1).cast("int").alias("k"))
    out = _salted(t, shared, ["host", "node"], "segs")
    more = F.array_join(F.transform(F.slice("segs", F.col("d") + 1, F.col("k")), lambda x: F.concat(F.lit("/"), x)), "")
    return out.withColumns({"node": F.concat("node", more), "d": F.col("d") + F.col("k")}).drop("k")


def _branched(t: DataFrame) -> DataFrame:
    """Open templates moved down one segment, into the merged branch that has it."""
    here = ["host", "node"]
    t = t.withColumn("seg", F.get("segs", "d"))
    child = t.groupBy(*here, "seg").agg(F.sum("n").alias("n"), F.sum("n_block").alias("b"), F.sum("n_allow").alias("a"), F.max("p").alias("p"))
    kids = child.groupBy(*here).agg(F.count("*").alias("kids"), F.sum("n").alias("of")).select(*here, "kids", ((F.col("kids") >= MANY) & (F.col("of") < RARE * F.col("kids"))).alias("wide"))
    child = _salted(child, kids, here, "seg").withColumn("name", F.when(F.col("wide") & ~F.col("seg").startswith("<"), "*").otherwise(F.col("seg")))
    branch = child.groupBy(*here, "name").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.max("p").alias("p"), F.max("kids").alias("kids"))
    # branches of one purity in hundredths are one before the test: at most 101 rows a node are put in order
    branch = branch.withColumn("bin", F.when(F.col("a") + F.col("b") > 0, F.floor(100 * F.col("b") / (F.col("a") + F.col("b")))).otherwise(-1))
    bins = branch.filter("bin >= 0").groupBy(*here, "bin").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    order = W.partitionBy(*here).orderBy("bin")
    b0, n0, n1 = F.lag("b").over(order), F.lag(F.col("a") + F.col("b")).over(order), F.col("a") + F.col("b")
    pool = (b0 + F.col("b")) / (n0 + n1)
    z = F.abs(b0 / n0 - F.col("b") / n1) / F.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1))
    bins = bins.withColumn("edge", F.coalesce((z >= Z).cast("int"), F.lit(0))).withColumn("class", F.sum("edge").over(order))
    of_class = bins.groupBy(*here, "class").agg(F.sum("b").alias("cb"), F.sum("a").alias("ca"))
    bins = bins.select(*here, "bin", "class").join(of_class, [*here, "class"])
    branch = _salted(branch, bins, [*here, "bin"], "name", "left").withColumn("class", F.coalesce("class", F.lit(-1)))  # without labels: apart, on the parent's purity
    names = branch.groupBy(*here, "class").agg(F.min("name").alias("first"), F.count("*").alias("m"))
    branch = _salted(branch, names, [*here, "class"], "name")
    label = F.when(F.col("m") == 1, F.col("first")).otherwise(F.concat(F.lit("{"), "first", F.lit("|+"), (F.col("m") - 1).cast("string"), F.lit("}")))
    purity = F.when(F.col("kids") == 1, F.col("p")).otherwise(_smooth(F.coalesce("cb", F.lit(0)), F.coalesce("ca", F.lit(0)), F.col("p")))
    branch = branch.select(*here, "name", label.alias("label"), purity.alias("q"))
    to = _salted(child.select(*here, "seg", "name"), branch, [*here, "name"], "seg").select(*here, "seg", "label", "q")
    out = _salted(t, to, [*here, "seg"], "segs")
    return out.withColumns({"node": F.concat("node", F.lit("/"), "label"), "p": F.col("q"), "d": F.col("d") + 1}).drop("seg", "label", "q")

def template_verdicts(counts: DataFrame) -> DataFrame:
    """``host, segs, template, purity, rejected`` for ``counts(host, segs, n, n_block, n_allow)``.

    There are as many rounds as branchings on the way to the deepest template.
    """
    hosts = counts.groupBy("host").agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a"))
    hosts = hosts.select("host", _smooth(F.col("b"), F.col("a"), F.lit(0.0)).alias("p"))  # without evidence a host is allowed
    t = _salted(counts, hosts, ["host"], "segs").withColumns({"node": F.lit(""), "d": F.lit(0)})
    t, at = written(t, "templates")
    is_open = F.size("segs") > F.col("d")
    while t.filter(is_open).head(1):
        moved = _along(t.filter(is_open))
        t = t.filter(~is_open).unionByName(moved.filter(~is_open)).unionByName(_branched(moved.filter(is_open)))
        t, new_at = written(t, "templates")
        drop_path(t.sparkSession, at)
        at = new_at
    return t.select("host", "segs", F.col("node").alias("template"), F.col("p").alias("purity"), (F.col("p") >= REJECT).alias("rejected"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict, template`` for each row.

    ``template`` is null where a rule decides. A null URL, or one without ``://``, has an empty
    host and path, fits no rule and is allowed; whole URLs are read, however long; of rules of equal length the later one counts. Null ids are kept, repeated rows each
    judged (equal URLs alike), an empty table gives no rows, other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("u")).select("id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "said": said, "segs": segment_forms(F.col("path"))})
    counts = rows.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("said") == "block", 1)).alias("n_block"), F.count(F.when(F.col("said") == "allow", 1)).alias("n_allow")
    )
    templates, _ = written(template_verdicts(counts), "verdicts")
    salted = templates.select("host", "segs", "template", "rejected", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    out = left.join(salted, ["host", "segs", "salt"], "left")
    verdict = F.coalesce("said", F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("said").isNull(), F.col("template")).alias("template"))
