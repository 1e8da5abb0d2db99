"""Overviews, budgeted packing of text blocks, and the contexts put together from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.prefix import running
from storyloom.session import shuffle_width


def entity_cloud(entities: DataFrame, mentions: DataFrame, limit: int) -> DataFrame:
    """(id, name, type, weight): the entities with most mentions, those without weighing 0; ties by id. Mentions are counted before the join."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    rows = entities.join(counts, "id", "left").select("id", F.col("canonical_name").alias("name"), "type", F.coalesce("n", F.lit(0)).alias("weight"))
    return rows.orderBy(F.desc("weight"), "id").limit(limit)


def overview(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(book_id, measure, n): of every table the rows by book and measure. tables: name -> (rows with book_id, label of a row)."""
    out = None
    for name, (rows, label) in tables.items():
        part = rows.groupBy("book_id", F.concat(F.lit(f"{name}."), F.coalesce(label, F.lit("none"))).alias("measure")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def packed_blocks(blocks: DataFrame, group: str, order: list[Column], budget: int) -> DataFrame:
    """Blocks (group, size) that fit a budget one after another; the first that does not fit ends it. With `used`."""
    sized = running(blocks, [group], order, {"used": F.col("size").cast("bigint")})
    return sized.where(F.col("used") <= budget).drop("rank")


def cut_blocks(blocks: DataFrame, group: str, order: list[Column], budget: int, cap: int) -> DataFrame:
    """Blocks (group, size), each cut to `cap` and to what is left of the budget: with `kept`, without those of which nothing is."""
    capped = F.least(F.col("size").cast("bigint"), F.lit(cap))
    upto = running(blocks, [group], order, {"_to": capped})
    kept = F.least(F.col("_to"), F.lit(budget)) - F.least(F.col("_to") - capped, F.lit(budget))
    return upto.withColumn("kept", kept).where("kept > 0").drop("rank", "_to")


def batches(chapters: DataFrame, group: str, order: list[str], most: int, room: int) -> DataFrame:
    """(id, batch): consecutive chapters (group, id, cost, alone) taken together while at most `most` and costing at most `room`.

    A chapter marked `alone` makes a batch of its own. Chapters stream by in order, so no group is held in memory.
    """
    sorted_ = chapters.select(*dict.fromkeys([group, *order, "id", "cost", "alone"])).repartition(shuffle_width(chapters.sparkSession), group).sortWithinPartitions(group, *order)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used, n, shut = object(), 0, 0, 0, True
        for frame in frames:
            out = []
            for g, cost, alone in zip(frame[group], frame["cost"], frame["alone"]):
                g = None if pd.isna(g) else g
                if g != now:
                    now, batch, used, n, shut = g, 0, 0, 0, True
                if shut or alone or n >= most or used + cost > room:
                    batch, used, n = batch + 1, 0, 0
                used, n, shut = used + cost, n + 1, alone
                out.append(batch)
            yield pd.DataFrame({"id": frame["id"], "batch": out})

    return sorted_.mapInPandas(fold, "id string, batch int")


def latest(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of every group by order (given descending)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group with their place `pos` from 1."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("pos") <= n)


def facts_by_entity(mentions: DataFrame) -> DataFrame:
    """(chapter_id, entity_id, facts): the facts of an entity in a chapter, in order. A list is as long as what one chapter says of one entity; facts without a chapter or an entity are in none."""
    return mentions.where("fact IS NOT NULL AND chapter_id IS NOT NULL AND entity_id IS NOT NULL").groupBy("chapter_id", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "fact"))), lambda x: x["fact"]).alias("facts"))


def event_line(idx: Column) -> Column:
    """The line by which an event is shown in a context."""
    blank = F.lit("")
    label = F.when(idx.isNull(), "?").otherwise(F.concat(F.lit("第 "), (idx + 1).cast("string"), F.lit(" 章")))
    place = F.when(F.coalesce("where_loc", blank) == "", "").otherwise(F.concat(F.lit("（"), "where_loc", F.lit("）")))
    return F.concat(F.lit("- **"), label, F.lit("** ("), F.coalesce("story_time", blank), F.lit("): "), F.coalesce("who", blank), F.lit(" — "), F.coalesce("what", blank), place)
