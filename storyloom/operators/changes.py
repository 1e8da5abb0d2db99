"""Writes: every change takes tables to tables; a merge is a full outer join, a removal an anti join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import forget, written

#: Rounds in which a chain of merges is followed; each doubles its length.
MOST_ROUNDS = 40


def upserted(old: DataFrame, new: DataFrame, key: list[str], defaults: dict[str, object] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in: a null in new keeps the old value, a new row takes the defaults, columns in keep never change once set."""
    columns = [c for c in old.columns if c not in key]
    a = old.select(*key, *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = new.select(*key, *((F.col(c) if c in new.columns else F.lit(None)).alias(f"_b_{c}") for c in columns))

    def value(c: str) -> Column:
        order = (f"_a_{c}", f"_b_{c}") if c in keep else (f"_b_{c}", f"_a_{c}")
        return F.coalesce(*order, F.lit((defaults or {}).get(c))).cast(old.schema[c].dataType).alias(c)

    return a.join(b, key, "full_outer").select(*key, *map(value, columns))


def last_written(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows for one key the last, by order given descending."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def resolved(hints: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Open hints whose exact text, in their book, is resolved (book_id, hint, chapter_id, resolution) become resolved; the first chapter of several counts."""
    first = resolutions.groupBy("book_id", "hint").agg(F.min(F.struct("chapter_id", "resolution")).alias("_r"))
    hit = F.col("_r").isNotNull() & (F.col("status") == "open")
    return hints.join(first, ["book_id", "hint"], "left").withColumns({
        "status": F.when(hit, "resolved").otherwise(F.col("status")), "resolved_chapter_id": F.when(hit, F.col("_r.chapter_id")).otherwise(F.col("resolved_chapter_id")),
        "resolution": F.when(hit, F.col("_r.resolution")).otherwise(F.col("resolution")),
    }).drop("_r")


def without_chapters(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables (mentions, events, foreshadowing, rules, rule_mentions, entities) without what comes from the chapters in gone (chapter_id).

    Foreshadowing planted or resolved there goes; rules first seen there go with all their mentions; an
    entity first seen there goes if no mention is left of it.
    """
    drop = lambda df, column: df.join(gone.select(F.col("chapter_id").alias(column)).distinct(), column, "left_anti")
    mentions = drop(tables["mentions"], "chapter_id")
    rules = drop(tables["rules"], "first_chapter_id")
    kept_rules = rules.select(F.col("id").alias("rule_id"))
    first_seen = tables["entities"].join(gone.select(F.col("chapter_id").alias("first_chapter_id")).distinct(), "first_chapter_id", "left_semi")
    orphans = first_seen.select("id").join(mentions.select(F.col("entity_id").alias("id")), "id", "left_anti")
    return {
        "mentions": mentions, "events": drop(tables["events"], "chapter_id"), "foreshadowing": drop(drop(tables["foreshadowing"], "hint_chapter_id"), "resolved_chapter_id"),
        "rules": rules, "rule_mentions": drop(tables["rule_mentions"], "chapter_id").join(kept_rules, "rule_id", "left_semi"), "entities": tables["entities"].join(orphans, "id", "left_anti"),
    }


def followed(merges: DataFrame) -> DataFrame:
    """merges (from_id, into_id) with the last target of every chain; of several merges of one source the least target counts. A circle raises. Each round doubles how far a merge is followed."""
    now = written(merges.where("from_id <> into_id").groupBy("from_id").agg(F.min("into_id").alias("into_id")), "merges")
    for _ in range(MOST_ROUNDS):
        further = now.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("_next"))
        if now.join(further, "into_id", "left_semi").isEmpty():
            return now
        before, now = now, written(now.join(further, "into_id", "left").select("from_id", F.coalesce("_next", "into_id").alias("into_id")), "merges")
        forget(before)
    raise ValueError("merges run in a circle")


def merged_entities(entities: DataFrame, mentions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) after merges (from_id, into_id): facts repointed, aliases joined with the old names, first chapter filled in, counts derived. Chains are followed to their end."""
    merges = followed(merges)
    to = merges.select(F.col("from_id").alias("id"), "into_id")
    moved = mentions.join(merges.select(F.col("from_id").alias("entity_id"), "into_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("into_id", "entity_id")).drop("into_id")
    named = entities.join(to, "id", "left").withColumn("target", F.coalesce("into_id", "id"))
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("into_id").isNotNull(), F.array("canonical_name")).otherwise(F.array().cast("array<string>")))
    alias = named.select("target", F.explode(names).alias("a")).where(F.trim("a") != "").distinct()
    own = entities.select(F.col("id").alias("target"), F.col("canonical_name").alias("a"))
    aliases = alias.join(own, ["target", "a"], "left_anti").groupBy("target").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    first = named.groupBy("target").agg(F.coalesce(F.max(F.when(F.col("into_id").isNull(), F.col("first_chapter_id"))), F.min("first_chapter_id")).alias("first_chapter_id"))
    counts = moved.groupBy(F.col("entity_id").alias("target")).agg(F.count("*").alias("mention_cnt"))
    kept = named.where("into_id IS NULL").select("id", "book_id", "canonical_name", "type", "target")
    out = kept.join(aliases, "target", "left").join(first, "target", "left").join(counts, "target", "left")
    empty = F.array().cast("array<string>")
    return out.select("id", "book_id", "canonical_name", "type", F.coalesce("aliases", empty).alias("aliases"), "first_chapter_id", F.coalesce("mention_cnt", F.lit(0)).alias("mention_cnt")), moved


def folded_edits(log: DataFrame) -> DataFrame:
    """(record_id, field, value, edits): the value each field has after the edits (id, record_id, field, new_value, undone); undone edits don't count."""
    return log.where(~F.col("undone")).groupBy("record_id", "field").agg(F.max_by("new_value", "id").alias("value"), F.count("*").alias("edits"))


def undo_entries(log: DataFrame) -> DataFrame:
    """For every undone edit the entry that takes it back: the value its field had before, null if none."""
    over = Window.partitionBy("record_id", "field").orderBy("id")
    before = F.last(F.when(~F.col("undone"), F.col("new_value")), True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("old_value", before).where("undone").select("id", "record_id", "field", F.col("new_value").alias("taken_back"), "old_value")


def queue_state(log: DataFrame) -> DataFrame:
    """(key, status, attempts) from a log (id, key, action): enqueue makes a chapter pending again, whatever it was; error counts an attempt."""
    last = log.where(F.col("action").isin("enqueue", "claim", "done", "error")).groupBy("key").agg(
        F.max_by("action", "id").alias("last"), F.count_if(F.col("action") == "error").alias("attempts"), F.max(F.when(F.col("action") == "enqueue", F.col("id"))).alias("enqueued"))
    status = F.create_map(*(F.lit(x) for x in ("enqueue", "pending", "claim", "processing", "done", "done", "error", "error")))
    return last.where("enqueued IS NOT NULL").select("key", status[F.col("last")].alias("status"), "attempts", "enqueued")


def claimed(queue: DataFrame, n: int) -> DataFrame:
    """The n longest pending entries, marked as processing."""
    return queue.where("status = 'pending'").orderBy("enqueued", "key").limit(n).withColumn("status", F.lit("processing"))
