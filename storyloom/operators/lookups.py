"""Scans, joins and searches over the knowledge base."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.prefix import running
from storyloom.session import shuffle_width


def first_match(hits: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by order. A group of hits is as large as the matches of one key."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def names_to_entities(wanted: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (book_id, name) -> (book_id, name, entity_id): the entity so called, else one with that alias; the least id of several."""
    own = entities.select("book_id", F.col("canonical_name").alias("name"), F.col("id").alias("entity_id"), F.lit(0).alias("rank"))
    other = aliases.select("book_id", F.col("alias_raw").alias("name"), "entity_id", F.lit(1).alias("rank"))
    best = own.union(other).groupBy("book_id", "name").agg(F.min(F.struct("rank", "entity_id")).alias("b"))
    return wanted.distinct().join(best, ["book_id", "name"]).select("book_id", "name", F.col("b.entity_id").alias("entity_id"))


def names_in_texts(names: DataFrame, texts: DataFrame, slices: int = 16) -> DataFrame:
    """(text_id, entity_id): names (book_id, entity_id, name) found in texts (book_id, text_id, text), in any case.

    The names of a book make an automaton that reads each of its texts once, instead of a comparison of
    every name with every text. Texts of a book are dealt over `slices` tasks, each with the names. Blank names match nothing.
    """
    lowered = names.where(F.trim("name") != "").select("book_id", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("is_text"), F.col("entity_id").alias("id"), F.lower("name").alias("s"))
    rows = texts.where(F.col("text").isNotNull()).select("book_id", F.pmod(F.xxhash64("text_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(True).alias("is_text"), F.col("text_id").alias("id"), F.lower("text").alias("s"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, owners, automaton = None, {}, None
        for batch in batches:
            out = []
            for book, part, is_text, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (book, part) != now:
                    now, owners, automaton = (book, part), {}, None
                if not is_text:
                    owners.setdefault(text, set()).add(key)
                    continue
                if automaton is None and owners:
                    automaton = ahocorasick.Automaton()
                    for name, ids in owners.items():
                        automaton.add_word(name, tuple(ids))
                    automaton.make_automaton()
                if owners:
                    out += [(key, e) for e in {e for _, ids in automaton.iter(text) for e in ids}]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["text_id", "entity_id"])

    both = lowered.union(rows.select(lowered.columns)).repartition(shuffle_width(names.sparkSession), "book_id", "slice").sortWithinPartitions("book_id", "slice", "is_text")
    return both.mapInArrow(scan, "text_id string, entity_id string").distinct()


def _blocks(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of facts (id, entity_id, chapter_id, idx): (each with its rank in its entity by chapter, of each (entity, chapter) the first and last rank).

    Ranks come from counts per chapter and ranks within a chapter, so a hot entity is never sorted in one task.
    """
    sizes = facts.groupBy("entity_id", "idx", "chapter_id").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("entity_id").orderBy("idx", "chapter_id").rowsBetween(Window.unboundedPreceding, 0)
    blocks = sizes.withColumn("last", F.sum("n").over(upto)).withColumn("first", F.col("last") - F.col("n") + 1)
    within = Window.partitionBy("entity_id", "chapter_id", "idx").orderBy("id")
    ranked = facts.withColumn("r", F.row_number().over(within)).join(blocks.drop("n", "last"), ["entity_id", "chapter_id", "idx"]).withColumn("rank", F.col("first") + F.col("r") - 1)
    return ranked, blocks


def _at_ranks(blocks: DataFrame, ranks: Column, ranked: DataFrame) -> DataFrame:
    wanted = blocks.select("entity_id", "chapter_id", F.explode(ranks).alias("rank"))
    return wanted.join(ranked.select("entity_id", "rank", F.col("id").alias("mention_id")), ["entity_id", "rank"]).select("entity_id", "chapter_id", "mention_id")


def recent_before(facts: DataFrame, limit: int) -> DataFrame:
    """(entity_id, chapter_id, mention_id): of every entity in every chapter its `limit` latest facts of chapters before it."""
    ranked, blocks = _blocks(facts)
    earlier = F.col("first") - 1
    return _at_ranks(blocks.where("first > 1"), F.sequence(F.greatest(earlier - (limit - 1), F.lit(1)), earlier), ranked)


def elsewhere(facts: DataFrame, limit: int) -> DataFrame:
    """(entity_id, chapter_id, mention_id): of every entity in every chapter the first `limit` of its facts in other chapters."""
    ranked, blocks = _blocks(facts)
    before = F.least(F.col("first") - 1, F.lit(limit))
    none = F.array().cast("array<bigint>")
    head = F.when(before > 0, F.sequence(F.lit(1).cast("bigint"), before)).otherwise(none)
    tail = F.when(before < limit, F.sequence(F.col("last") + 1, F.col("last") + limit - before)).otherwise(none)
    return _at_ranks(blocks, F.concat(head, tail), ranked)


def lookup(kinds: list[tuple[str, DataFrame, list[str], list[str]]], query: str, limit: int) -> DataFrame:
    """(kind, id, shown, rank): the first `limit` records that contain the query in any case, kinds in the order given.

    kinds: (name, rows, columns searched, columns shown); an id column is needed.
    """
    found = []
    for rank, (name, rows, searched, shown) in enumerate(kinds):
        hay = F.lower(F.concat_ws(" ", *searched))
        found.append(rows.where(F.contains(hay, F.lit(query.lower()))).select(F.lit(rank).alias("rank"), F.lit(name).alias("kind"), F.col("id").cast("string").alias("id"), F.concat_ws(" | ", *shown).alias("shown")).orderBy("id").limit(limit))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy("rank", "id").limit(limit).select("kind", "id", "shown", "rank")


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with their position from 0 in their group."""
    return running(rows, [group], order, {}, "_r").withColumn("position", F.col("_r") - 1).drop("_r")
