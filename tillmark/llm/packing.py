"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest length are cut into full pieces and a tail. Rows
are dealt by id to packing groups of about ``group_rows`` rows, and those of a
group that repeated ids make too large by row, so the packing of a group needs
bounded memory and groups run apart; each group is packed by best fit, longest
pieces first, with bins of several sizes opened by least cost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (2048, 4096, 8192, 16384)


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its offset within the bin, and the capacity of each bin.

    Pieces of 1 to ``max(capacities)`` go longest first to the open bin with the
    least room that suffices. If there is none, a bin of the size is opened whose
    cost (size plus ``overhead``) for each position that can still be filled is
    least; what can be filled is read off the lengths that are left. In the
    end each bin shrinks to the smallest permitted size that holds its contents.
    """
    caps = sorted(capacities)
    left = [0] * (caps[-1] + 1)
    for n in lengths:
        left[n] += 1
    present = sum(1 << n for n in range(1, caps[-1] + 1) if left[n])  # bit n: a piece of n is left
    rooms: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    free = 0  # bit n: a bin with room n is open
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bin_of, offset, used = [0] * len(lengths), [0] * len(lengths), []
    size: list[int] = []

    def fill(space: int, first: int) -> int:
        """Positions that the longest fitting pieces that are left would fill, each length as often as it is left."""
        filled, n = 0, space + 1
        while space > 0:
            n = (present & ((1 << min(n, space + 1)) - 1)).bit_length() - 1
            if n <= 0:
                break
            take = min(left[n] - (n == first), space // n)
            filled, space = filled + take * n, space - take * n
        return filled

    for i in order:
        n = lengths[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: ((c + overhead) / (n + fill(c - n, n)), c))
            b, room = len(used), cap
            used.append(0)
            size.append(cap)
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if room > n:
            rooms[room - n].append(b)
            free |= 1 << (room - n)
    return bin_of, offset, [caps[bisect_left(caps, u)] for u in used]


def pack(df: DataFrame, length: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64, group_rows: int = 4000) -> DataFrame:
    """Pieces of each row's ``length`` tokens and where they stand.

    Returns ``id_col, piece, start, n_tokens, bin, capacity, bin_offset``; ``bin`` is
    ``group-number`` (``group.part-number`` in a group dealt again). A null or negative
    length counts as 0 and gives one piece of 0 tokens in no bin (``bin`` null); null and
    repeated ids are rows of their own, however many; a very long text is as many pieces as
    it takes; other columns are left out, whatever their names; an empty table gives no
    rows. No piece is dropped and none cut except at the largest size.
    """
    most = max(capacities)
    base = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    groups = max(1, -(-base.count() // group_rows))
    dealt = base.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long"))
    # One id may have a third of all rows. There is a row for each group above four times the usual size, so one in so many rows at most.
    over = dealt.groupBy("grp").count().filter(F.col("count") > 4 * group_rows).select("grp", F.ceil(F.col("count") / group_rows).alias("parts"))
    dealt = dealt.join(F.broadcast(over), "grp", "left").withColumn("sub", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)).cast("long"))
    pieces = dealt.selectExpr("id", "n", "grp", "sub", f"explode(sequence(0L, greatest(0L, (n - 1) div {most}))) as piece")
    pieces = pieces.selectExpr("id", "grp", "sub", "piece", f"piece * {most} as start", f"least(n - piece * {most}, {most}) as n_tokens")

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["id", "piece"], kind="stable", na_position="first").reset_index(drop=True)
        some = pdf.index[pdf["n_tokens"] > 0]
        bins, offsets, sizes = pack_lengths([int(x) for x in pdf.loc[some, "n_tokens"]], capacities, overhead)
        out = pdf[["id", "piece", "start", "n_tokens"]].copy()
        out["bin"], out["capacity"], out["bin_offset"] = None, None, None
        name = f"{key[0]}.{key[1]}" if key[1] else f"{key[0]}"
        out.loc[some, "bin"] = [f"{name}-{b}" for b in bins]
        out["capacity"] = out["capacity"].astype("Int64")
        out["bin_offset"] = out["bin_offset"].astype("Int64")
        out.loc[some, "capacity"] = [sizes[b] for b in bins]
        out.loc[some, "bin_offset"] = offsets
        yield out

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return next(run(key, iter([pdf])))

    id_type = dict(base.dtypes)["id"]
    done = pieces.groupBy("grp", "sub").applyInPandas(whole, f"id {id_type}, piece long, start long, n_tokens long, bin string, capacity long, bin_offset long")
    return done.withColumnRenamed("id", id_col)
