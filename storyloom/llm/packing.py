"""Items of varying length in containers of fixed capacity: minimum bin slack.

Items of one length are alike, so the plan needs only the number of items of each length
(at most `capacity` numbers, whatever the corpus). Per bin, the longest item left is
taken, and a dynamic program over bitsets of reachable sums finds the fullest
combination with it; the combination is removed as often as the items left allow.
Items are then dealt to the plan's slots by their rank among the items of their length.
The ranks come from counts by (length, hash slice), so a length that a third of all items
have is never ranked in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from storyloom.session import shuffle_width, written

CAPACITY = 2048


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, of the fullest combination of at most counts[length] items of each that fits room."""
    reached, history = 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most, part = min(counts[length], room // length), 1
        while most > 0:  # binary splitting of the number of items
            take = min(part, most)
            history.append((length, take, reached))
            reached |= (reached << (length * take)) & whole
            most, part = most - take, part * 2
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, []
    for length, take, before in reversed(history):
        if not before >> at & 1:
            at -= length * take
            chosen += [length] * take
    return sorted(chosen, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(times, lengths)]: bins that hold every item, by the fullest combination with the longest item left."""
    left, bins = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items()}
        chosen = [longest, *fullest({k: n for k, n in rest.items() if n}, capacity - longest)]
        needs = {k: chosen.count(k) for k in set(chosen)}
        times = min(left[k] // n for k, n in needs.items())
        bins.append((times, chosen))
        for k, n in needs.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start, length): items above capacity are cut into full pieces and a rest; empty and null sizes give none."""
    n = F.col(size)
    cut = items.where(n > 0).select(F.col(key), n.alias("_n"), F.posexplode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(capacity).cast("bigint"))).alias("piece_no", "start"))
    return cut.select(key, "piece_no", "start", F.least(F.col("_n") - F.col("start"), F.lit(capacity)).alias("length"))


def packed(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece_no, start, length, container): every piece in one container of at most `capacity`.

    items has one row per item (distinct keys). Items of size 0 or null are not packed; one above capacity is
    cut, its pieces in order have rising piece_no and containers. Containers are numbered from 0 without gaps.
    Equal sizes are dealt out by a hash of the key, then the key. A null key is an item of
    its own. No items give no rows. Other columns are dropped.
    """
    spark = items.sparkSession
    cut = pieces(items, key, size, capacity).withColumn("slice", F.pmod(F.xxhash64(key), F.lit(4 * shuffle_width(spark))).cast("int"))
    totals = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    totals = written(totals, "lengths")  # at most capacity * slices rows
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # a segment: items ranked from first_rank on, `each` of them to a container, go to containers from first_bin on
    segments, used, bins = [], dict.fromkeys(counts, 0), 0
    for times, lengths in plan(counts, capacity):
        for k in set(lengths):
            segments.append((k, used[k], lengths.count(k), bins))
            used[k] += lengths.count(k) * times
        bins += times
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 4)
    stride = int(table[:, 1].max(initial=0)) + 1 if len(table) else 1
    sent = spark.sparkContext.broadcast((table, table[:, 0] * stride + table[:, 1]))  # about capacity * ln(capacity) segments at most

    @pandas_udf(LongType())
    def container(length, rank):
        rows, firsts = sent.value
        wanted = length.to_numpy() * stride + np.minimum(rank.to_numpy(), stride - 1)
        _, first_rank, each, first_bin = rows[np.searchsorted(firsts, wanted, "right") - 1].T
        return pd.Series(first_bin + (rank.to_numpy() - first_rank) // each)

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "slice", "offset")
    within = Window.partitionBy("length", "slice").orderBy(key, "piece_no")
    ranked = cut.withColumn("n", F.row_number().over(within) - 1).join(offsets, ["length", "slice"]).withColumn("rank", F.col("offset") + F.col("n"))
    return ranked.select(key, "piece_no", "start", "length", container("length", "rank").alias("container"))


def fill(assigned: DataFrame) -> DataFrame:
    """(container, pieces, used): what each container holds."""
    return assigned.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("length").alias("used"))
