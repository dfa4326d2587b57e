"""Chat formatting into budgeted windows, with a loss mask.

Column expressions only. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark, and
reading back undoes it; a role also writes its line ends as ``\\n``. Prefix sums of
the turns' lengths choose windows that begin and end at turns: each keeps the
conversation's leading system turn, repeats a limited history from before its
first new turn, and masks what it repeats, so each target counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Code points of a window, those its history may take, and turns of the history.
BUDGET, HISTORY, HISTORY_TURNS = 4096, 1024, 2


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n")))), "\\")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, target: str = "assistant") -> DataFrame:
    """``conv_id, window, formatted, n_repeated, spans`` for each window.

    ``spans`` are the (first code point from 0, length) of each target text in ``formatted``
    that the loss counts; the first ``n_repeated`` turns are the system turn and the history
    (of window 0: none). A window exceeds ``budget`` only where it has one new turn beside the system turn.
    Turns stand by ``turn`` (null first), ties by role and text; null texts and roles are
    empty; a null ``conv_id`` is one conversation; an empty table gives no rows; a
    conversation is the unit of work and is held whole.
    """
    rendered = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            rendered.alias("out"),
            F.length(rendered).alias("cost"),
            (F.length(escape_role(F.col("role"))) + len(START) + 1).alias("lead"),
            F.length(escape(F.col("text"))).alias("size"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # the window of each turn: a new one begins where the running length would pass what system turn and history leave
    sys_cost = F.expr("if(ts[0].role = 'system', ts[0].cost, 0)")
    convs = convs.withColumn("sys", F.expr("if(ts[0].role = 'system', 1, 0)")).withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - sys_cost))
    cuts = F.expr("""
        aggregate(slice(ts, sys + 1, size(ts)),
          named_struct('used', 0L, 'at', sys, 'cuts', array(sys)),
          (s, t) -> if(s.used > 0 and s.used + t.cost > room,
            named_struct('used', cast(t.cost as long), 'at', s.at + 1, 'cuts', concat(s.cuts, array(s.at))),
            named_struct('used', s.used + t.cost, 'at', s.at + 1, 'cuts', s.cuts)),
          s -> s.cuts)""")
    convs = convs.withColumn("cuts", cuts)
    w = convs.select("conv_id", "ts", "sys", "cuts", F.posexplode("cuts").alias("window", "first"))
    w = w.withColumn("end", F.expr("if(window + 1 < size(cuts), cuts[window + 1], size(ts))"))
    # history: the turns just before the first new one that fit, few at most
    back = F.lit(0)
    for k in range(1, history_turns + 1):
        fits = F.expr(f"window > 0 and first - {k} >= sys and aggregate(slice(ts, greatest(first - {k} + 1, 1), {k}), 0L, (s, t) -> s + t.cost) <= {history}")
        back = F.when(fits, k).otherwise(back)
    w = w.withColumn("back", back)
    w = w.withColumn("n_repeated", F.expr("if(window > 0, sys + back, 0)"))
    w = w.withColumn("shown", F.expr("concat(slice(ts, 1, if(window > 0, sys, 0)), slice(ts, if(window > 0, first - back, 0) + 1, end - if(window > 0, first - back, 0)))"))
    spans = F.expr(f"""
        aggregate(shown, named_struct('at', 0L, 'k', 0, 'spans', cast(array() as array<struct<begin: bigint, length: bigint>>)),
          (s, t) -> named_struct('at', s.at + t.cost, 'k', s.k + 1, 'spans',
            if(t.role = '{target}' and s.k >= n_repeated, concat(s.spans, array(named_struct('begin', s.at + t.lead, 'length', cast(t.size as long)))), s.spans)),
          s -> s.spans)""")
    return w.select("conv_id", "window", F.array_join(F.transform("shown", lambda t: t["out"]), "").alias("formatted"), "n_repeated", spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns(role, text), loss, formatted_chars`` of whole conversations, from their windows alone."""
    mark = r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"
    new = F.expr("slice(bodies, n_repeated + 1, size(bodies))")
    w = formatted.withColumn("bodies", F.regexp_extract_all("formatted", F.lit(mark), F.lit(1))).select(
        "conv_id",
        F.struct(
            "window",
            F.transform(
                new,
                lambda b: F.struct(
                    unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text")
                ),
            ).alias("turns"),
            F.array_join(F.transform("spans", lambda s: unescape(F.substring("formatted", s["begin"].cast("int") + 1, s["length"].cast("int")))), "").alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    c = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return c.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda x: x["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda x: x["loss"]), "").alias("loss"),
        F.expr("aggregate(ws, 0L, (s, x) -> s + x.chars)").alias("formatted_chars"),
    )
