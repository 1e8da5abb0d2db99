"""Timeline: defaults, zoom, segments, arrangement, chains and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.prefix import running
from storyloom.operators.changes import upserted
from storyloom.schemas import DEFAULTS

UNPLACED = 9999
# Titles of events without a segment, laid out or not.
MAIN_TITLE, NARRATED_TITLE = "主线", "叙述顺序"


def in_order(events: DataFrame) -> DataFrame:
    """events (id, book_id, idx, created_at, story_order, lane) with `place`, from 1, in the whole book: by story order (else idx * 1000), lane (else 0), idx, time and id; nulls first."""
    order = [F.coalesce("story_order", F.col("idx") * 1000), F.coalesce("lane", F.lit(0)), F.col("idx"), F.col("created_at"), F.col("id")]
    return running(events, ["book_id"], order, {}, "place")


def with_defaults(events: DataFrame) -> DataFrame:
    """Layout values of events (in_order(), with consequence and nullable meta columns).

    Without meta: order idx * 1000 + 10 * place (idx 9999 where it is null), importance 3 with a consequence else 2,
    zoom 1 from importance 4 on else 2, segment 'main', confidence 0.5, status 'fallback'.
    """
    importance = F.coalesce("importance", F.when(F.coalesce("consequence", F.lit("")) != "", 3).otherwise(2))
    or_else = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    status, confidence = or_else("status", "fallback"), F.coalesce("confidence", F.lit(0.5))
    return events.select(
        "id", "book_id", "chapter_id", "idx",
        F.coalesce("story_order", F.coalesce("idx", F.lit(UNPLACED)) * 1000 + 10 * F.col("place")).cast("bigint").alias("story_order"),
        F.coalesce("lane", F.lit(0)).alias("lane"), importance.alias("importance"), F.coalesce("zoom_level", F.when(importance >= 4, 1).otherwise(2)).alias("zoom_level"),
        or_else("segment_id", "main").alias("segment_id"), or_else("segment_title", MAIN_TITLE).alias("segment_title"), status.alias("status"), ((confidence < 0.7) | (status == "fallback")).alias("uncertain"),
    )


def fallback_arrangement(events: DataFrame) -> DataFrame:
    """Meta rows for the events of in_order() that have no story order yet: ten times their place from 0, importance by consequence; events laid out before keep theirs and get no row."""
    return events.where("story_order IS NULL").select(
        F.col("id").alias("event_id"), "book_id", ((F.col("place") - 1) * 10).alias("story_order"), F.lit("main").alias("segment_id"), F.lit(NARRATED_TITLE).alias("segment_title"), F.lit(0).alias("lane"),
        F.when(F.coalesce("consequence", F.lit("")) != "", 3).otherwise(2).alias("importance"), F.lit(2).alias("zoom_level"), F.lit(0.45).alias("confidence"), F.lit("fallback").alias("status"),
    )


def catalog(events: DataFrame, most: int = 180) -> DataFrame:
    """What a layout is asked for: the first `most` events of every book (in_order(), with chapter_title and their columns) and where they were put before."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    before = lambda c: F.col(c).alias(f"previous_{c}")
    return events.where(F.col("place") <= most).select(
        "id", "book_id", "place", (F.col("idx") + 1).alias("chapter"), *map(blank, ("chapter_title", "story_time", "who", "what")), F.coalesce("where_loc", F.lit("")).alias("where"), *map(blank, ("why", "consequence")),
        before("story_order"), F.coalesce("segment_id", F.lit("")).alias("previous_segment_id"), F.coalesce("segment_title", F.lit("")).alias("previous_segment_title"), before("lane"), before("importance"), before("zoom_level"), F.coalesce("status", F.lit("")).alias("previous_status"),
    )


def visible(events: DataFrame, zoom: int, focus: Column | None = None) -> DataFrame:
    """Events shown at a zoom: 2 all, 1 from importance 3, 0 from importance 4, or in focus; at 0, segments of a book without any show their first."""
    focus = F.lit(False) if focus is None else F.coalesce(focus, F.lit(False))
    if zoom >= 2:
        return events
    if zoom == 1:
        return events.where((F.col("importance") >= 3) | focus)
    marked = events.withColumn("_shown", (F.col("importance") >= 4) | focus)
    some = marked.groupBy("book_id").agg(F.max("_shown").alias("_some"))
    firsts = events.groupBy("book_id", "segment_id").agg(F.min(F.struct("story_order", "id")).alias("_f")).select("book_id", F.col("_f.id").alias("id"), F.lit(True).alias("_first"))
    joined = marked.join(some, "book_id").join(firsts, ["book_id", "id"], "left")
    return joined.where(F.when(F.col("_some"), F.col("_shown")).otherwise(F.coalesce("_first", F.lit(False)))).select(*events.columns)


def segments(events: DataFrame) -> DataFrame:
    """(book_id, segment_id, first_order, first_lane, events, uncertain) of each segment."""
    return events.groupBy("book_id", "segment_id").agg(
        F.min(F.struct("story_order", "lane")).alias("_f"), F.count("*").alias("events"), F.count_if("uncertain").alias("uncertain")
    ).select("book_id", "segment_id", F.col("_f.story_order").alias("first_order"), F.col("_f.lane").alias("first_lane"), "events", "uncertain")


def map_stats(events: DataFrame) -> DataFrame:
    """Per book: total, uncertain, and whether any event was laid out by other than the fallback."""
    return events.groupBy("book_id").agg(F.count("*").alias("total"), F.count_if("uncertain").alias("uncertain"), F.bool_or(F.col("status") != "fallback").alias("laid_out"))


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    """A loosely typed number as an integer within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


def placed(placements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Placements (event_id, story_order, lane, importance, zoom_level, confidence as text) of known events as meta rows, numbers clamped or set to their default.

    An event placed by a user keeps its order and lane and is certain; unknown events are refused. catalog: (id, book_id, status, story_order, lane), the last two as stored.
    """
    known = catalog.select(F.col("id").alias("event_id"), "book_id", F.col("status").alias("_status"), F.col("story_order").alias("_order"), F.col("lane").alias("_lane"))
    by_user = F.coalesce(F.col("_status") == "user", F.lit(False))
    number = lambda c, d: F.coalesce(F.col(c).try_cast("int"), F.lit(d))
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))
    return placements.join(known, "event_id").select(
        "event_id", "book_id", F.when(by_user, F.coalesce("_order", number("story_order", 0))).otherwise(number("story_order", 0)).alias("story_order"),
        F.when(by_user, F.coalesce("_lane", number("lane", 0))).otherwise(number("lane", 0)).alias("lane"),
        clamped(F.col("importance"), 1, 5, 2).alias("importance"), clamped(F.col("zoom_level"), 0, 2, 2).alias("zoom_level"),
        F.when(by_user, F.greatest(sure, F.lit(1.0))).otherwise(sure).alias("confidence"), F.when(by_user, "user").otherwise("ai").alias("status"),
    )


def meta_upserted(meta: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """Meta rows with changes put in by event_id: a null keeps the old value, a new row takes the defaults, a change without a status is one by 'ai', events that are not there are refused."""
    known = changes.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").withColumn("status", F.coalesce("status", F.lit("ai")))
    return upserted(meta, known, ["event_id"], DEFAULTS["timeline_event_meta"])


def without_ai_relations(relations: DataFrame) -> DataFrame:
    """Relations that were not set by 'ai'."""
    return relations.where("status IS DISTINCT FROM 'ai'")


def relations_checked(relations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Relations whose source is known; an unknown target becomes null."""
    ids = catalog.select(F.col("id").alias("source_event_id"))
    targets = catalog.select(F.col("id").alias("target_event_id"), F.lit(True).alias("_known"))
    kept = relations.join(ids, "source_event_id", "left_semi").join(targets, "target_event_id", "left")
    return kept.withColumn("target_event_id", F.when(F.col("_known"), F.col("target_event_id"))).drop("_known")


def merged_spans(spans: DataFrame, key: str, gap: int) -> DataFrame:
    """(key, start, end): spans (key, start, end) merged where the next begins at most `gap` after the furthest end before it.

    A key's spans are sorted in one task; spans are first merged within slices of start so that a hot key
    brings few. slices are as wide as 1,000 gaps.
    """

    def once(rows: DataFrame, by: list[str]) -> DataFrame:
        over = Window.partitionBy(*by).orderBy("start", "end")
        reach = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(F.coalesce(F.col("start") - reach > gap, F.lit(True)), 1).otherwise(0)
        island = rows.withColumn("_o", opens).withColumn("_i", F.sum("_o").over(over.rowsBetween(Window.unboundedPreceding, 0)))
        return island.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")

    sliced = spans.select(key, "start", "end", F.floor(F.col("start") / F.lit(max(1, gap) * 1000)).alias("_s"))
    return once(once(sliced, [key, "_s"]).drop("_s"), [key])


def boundaries(chapters: DataFrame) -> DataFrame:
    """Chapters (pos, book_id, explicit) of one reading order with `boundary`: a volume begins there. explicit marks a stated boundary.

    A boundary is stated or implied by a change of book; the first chapter has one only if stated. One work's order is sorted in one task.
    """
    over = Window.partitionBy("work_id").orderBy("pos")
    changed = F.lag("book_id").over(over).isNotNull() & (F.lag("book_id").over(over) != F.col("book_id"))
    return chapters.withColumn("boundary", F.col("explicit") | changed)
