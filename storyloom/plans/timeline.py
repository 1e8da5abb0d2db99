"""Queries of operators/timeline.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import timeline as op
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()

_EVENTS = """
(SELECT h.*, c.idx, c.title AS chapter_title, m.lane, m.segment_id, m.segment_title, m.status, m.confidence, m.story_order, m.importance, m.zoom_level,
   row_number() OVER (PARTITION BY h.book_id ORDER BY coalesce(m.story_order, c.idx * 1000) NULLS FIRST, coalesce(m.lane, 0), c.idx NULLS FIRST, h.created_at NULLS FIRST, h.id) AS place
 FROM {kb_happenings} h LEFT JOIN {kb_chapters} c ON c.id = h.chapter_id AND c.book_id = h.book_id LEFT JOIN {kb_timeline_meta} m ON m.event_id = h.id)"""
_IMPORTANCE = "coalesce(importance, CASE WHEN coalesce(consequence, '') <> '' THEN 3 ELSE 2 END)"
_LAID = f"""
(SELECT id, book_id, chapter_id, idx, CAST(coalesce(story_order, coalesce(idx, 9999) * 1000 + 10 * place) AS BIGINT) AS story_order, coalesce(lane, 0) AS lane, {_IMPORTANCE} AS importance,
   coalesce(zoom_level, CASE WHEN {_IMPORTANCE} >= 4 THEN 1 ELSE 2 END) AS zoom_level, coalesce(segment_id, 'main') AS segment_id, coalesce(segment_title, '主线') AS segment_title, coalesce(status, 'fallback') AS status,
   coalesce(confidence, 0.5) < 0.7 OR coalesce(status, 'fallback') = 'fallback' AS uncertain FROM {_EVENTS})"""


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = view(spark, sf_dir, "kb_chapters").select(F.col("id").alias("chapter_id"), "book_id", "idx", F.col("title").alias("chapter_title"))
    meta = view(spark, sf_dir, "kb_timeline_meta").drop("book_id").withColumnRenamed("event_id", "id")
    return op.in_order(view(spark, sf_dir, "kb_happenings").join(chapters, ["chapter_id", "book_id"], "left").join(meta, "id", "left"))


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_defaults(_ordered(spark, sf_dir))


@query(f"SELECT id, story_order, lane, importance, zoom_level, segment_id, segment_title, status, uncertain FROM {_LAID}")
def timeline_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, W2"""
    return _laid(spark, sf_dir).drop("book_id", "chapter_id", "idx")


@query(f"""
SELECT id, book_id, place, idx + 1 AS chapter, coalesce(chapter_title, '') AS chapter_title, coalesce(story_time, '') AS story_time, coalesce(who, '') AS who, coalesce(what, '') AS what, coalesce(where_loc, '') AS "where", coalesce(why, '') AS why, coalesce(consequence, '') AS consequence,
  story_order AS previous_story_order, coalesce(segment_id, '') AS previous_segment_id, coalesce(segment_title, '') AS previous_segment_title, lane AS previous_lane, importance AS previous_importance, zoom_level AS previous_zoom_level, coalesce(status, '') AS previous_status
FROM {_EVENTS} WHERE place <= 180""")
def timeline_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 180 events of every book, as a layout is asked for"""
    return op.catalog(_ordered(spark, sf_dir))


@query(f"""
WITH laid AS (SELECT * FROM {_LAID}), marked AS (SELECT *, max(CASE WHEN importance >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) AS any_shown,
  row_number() OVER (PARTITION BY book_id, segment_id ORDER BY story_order, id) AS n FROM laid)
SELECT id, book_id, segment_id, story_order FROM marked WHERE CASE WHEN any_shown = 1 THEN importance >= 4 ELSE n = 1 END""")
def timeline_zoom_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, W3"""
    return op.visible(_laid(spark, sf_dir), 0).select("id", "book_id", "segment_id", "story_order")


@query(f"SELECT id, book_id, segment_id, story_order FROM {_LAID} WHERE importance >= 3 OR idx = 5")
def timeline_zoom_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the chapters of index 5 in focus"""
    return op.visible(_laid(spark, sf_dir), 1, F.col("idx") == 5).select("id", "book_id", "segment_id", "story_order")


@query(f"""
SELECT book_id, segment_id, min(story_order) AS first_order, arg_min(lane, (story_order, lane)) AS first_lane, count(*) AS events, count(*) FILTER (WHERE uncertain) AS uncertain
FROM {_LAID} GROUP BY book_id, segment_id""")
def timeline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9"""
    return op.segments(_laid(spark, sf_dir))


@query(f"SELECT book_id, count(*) AS total, count(*) FILTER (WHERE uncertain) AS uncertain, bool_or(status <> 'fallback') AS laid_out FROM {_LAID} GROUP BY book_id")
def timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return op.map_stats(_laid(spark, sf_dir))


@query(f"""
SELECT id AS event_id, book_id, (place - 1) * 10 AS story_order, 'main' AS segment_id, '叙述顺序' AS segment_title, 0 AS lane, CASE WHEN coalesce(consequence, '') <> '' THEN 3 ELSE 2 END AS importance, 2 AS zoom_level, 0.45::DOUBLE AS confidence, 'fallback' AS status
FROM {_EVENTS} WHERE story_order IS NULL""")
def fallback_arrangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, W2"""
    return op.fallback_arrangement(_ordered(spark, sf_dir))


_PLACEMENTS = "(SELECT concat(CASE WHEN created_at % 11 = 0 THEN 'x' ELSE '' END, id) AS event_id, CASE WHEN created_at % 6 = 0 THEN NULL ELSE CAST(created_at % 9000 - 500 AS VARCHAR) END AS story_order, CASE WHEN created_at % 5 = 0 THEN 'left' ELSE CAST(created_at % 40 AS VARCHAR) END AS lane, CAST(created_at % 9 - 1 AS VARCHAR) AS importance, CAST(created_at % 5 AS VARCHAR) AS zoom_level, CASE WHEN created_at % 4 = 1 THEN 'sure' ELSE CAST((created_at % 8) / 8 AS VARCHAR) END AS confidence FROM {kb_happenings})"
_INT = "coalesce(TRY_CAST({0} AS INT), {1})"
_SURE = "coalesce(TRY_CAST(p.confidence AS DOUBLE), 0.5)"
_PLACED = f"""(SELECT p.event_id, e.book_id, CASE WHEN e.status = 'user' THEN coalesce(e.story_order, {_INT.format('p.story_order', 0)}) ELSE {_INT.format('p.story_order', 0)} END AS story_order,
  CASE WHEN e.status = 'user' THEN coalesce(e.lane, {_INT.format('p.lane', 0)}) ELSE {_INT.format('p.lane', 0)} END AS lane, greatest(1, least(5, {_INT.format('p.importance', 2)})) AS importance, greatest(0, least(2, {_INT.format('p.zoom_level', 2)})) AS zoom_level,
  CASE WHEN e.status = 'user' THEN greatest({_SURE}, 1.0) ELSE {_SURE} END AS confidence, CASE WHEN e.status = 'user' THEN 'user' ELSE 'ai' END AS status FROM {_PLACEMENTS} p JOIN {_EVENTS} e ON e.id = p.event_id)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("created_at")
    rows = view(spark, sf_dir, "kb_happenings").select(
        F.concat(F.when(t % 11 == 0, "x").otherwise(""), "id").alias("event_id"), F.when(t % 6 != 0, (t % 9000 - 500).cast("string")).alias("story_order"), F.when(t % 5 == 0, "left").otherwise((t % 40).cast("string")).alias("lane"),
        (t % 9 - 1).cast("string").alias("importance"), (t % 5).cast("string").alias("zoom_level"), F.when(t % 4 == 1, "sure").otherwise(((t % 8) / 8).cast("string")).alias("confidence"),
    )
    meta = view(spark, sf_dir, "kb_timeline_meta").select(F.col("event_id").alias("id"), "status", "story_order", "lane")
    return op.placed(rows, view(spark, sf_dir, "kb_happenings").select("id", "book_id").join(meta, "id", "left"))


@query(f"SELECT * FROM {_PLACED}")
def placements_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, J17, F19"""
    return _placed(spark, sf_dir)


@query(f"""
SELECT coalesce(p.event_id, m.event_id) AS event_id, coalesce(p.story_order, m.story_order) AS story_order, m.segment_id, coalesce(p.lane, m.lane) AS lane, coalesce(p.importance, m.importance) AS importance, coalesce(p.zoom_level, m.zoom_level) AS zoom_level, coalesce(p.confidence, m.confidence) AS confidence, coalesce(p.status, m.status) AS status
FROM {{kb_timeline_meta}} m FULL OUTER JOIN {_PLACED} p ON p.event_id = m.event_id""")
def meta_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the placements put into the stored layout"""
    after = op.meta_upserted(view(spark, sf_dir, "kb_timeline_meta"), _placed(spark, sf_dir), view(spark, sf_dir, "kb_happenings"))
    return after.select("event_id", "story_order", "segment_id", "lane", "importance", "zoom_level", "confidence", "status")


@query("""
SELECT h.id AS source_event_id, CASE WHEN t.id IS NOT NULL THEN t.id END AS target_event_id, CASE WHEN h.created_at % 2 = 0 THEN 'before' ELSE 'same_time' END AS relation
FROM {kb_happenings} h LEFT JOIN {kb_happenings} t ON t.id = CASE WHEN h.created_at % 3 = 0 THEN h.id ELSE concat('gone-', h.id) END
UNION ALL SELECT id, NULL, 'uncertain' FROM {kb_happenings} WHERE created_at % 4 <> 1""")
def relations_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations set by 'ai' make way for the new ones, those of a user stay"""
    t, events = F.col("created_at"), view(spark, sf_dir, "kb_happenings")
    rows = events.select(F.col("id").alias("source_event_id"), F.when(t % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("gone-"), "id")).alias("target_event_id"), F.when(t % 2 == 0, "before").otherwise("same_time").alias("relation"))
    old = events.select(F.col("id").alias("source_event_id"), F.lit(None).cast("string").alias("target_event_id"), F.lit("uncertain").alias("relation"), F.when(t % 4 == 1, "ai").when(t % 4 == 2, "user").alias("status"))
    return op.relations_checked(rows, events).unionByName(op.without_ai_relations(old).drop("status"))


@query("""
WITH spans AS (SELECT book_id, created_at // 3600 AS s, created_at // 3600 + length(coalesce(what, '')) AS e FROM {kb_happenings}),
marked AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY book_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 80 THEN 0 ELSE 1 END AS o FROM spans),
islands AS (SELECT *, sum(o) OVER (PARTITION BY book_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked)
SELECT book_id, min(s) AS "start", max(e) AS "end" FROM islands GROUP BY book_id, i""")
def spans_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    hour = F.floor(F.col("created_at") / 3600)
    spans = view(spark, sf_dir, "kb_happenings").select("book_id", hour.alias("start"), (hour + F.length(F.coalesce("what", F.lit("")))).alias("end"))
    return op.merged_spans(spans, "book_id", 80)


@query("""
WITH o AS (SELECT id, book_id, idx, row_number() OVER (ORDER BY idx NULLS FIRST, id) AS pos FROM {kb_chapters} WHERE book_id IS NOT NULL)
SELECT id, idx % 10 = 3 OR coalesce(lag(book_id) OVER (PARTITION BY idx % 50 ORDER BY pos) <> book_id, false) AS boundary FROM o""")
def volume_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works made of every chapter index, read by index and id"""
    rows = view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL").select("id", "book_id", (F.col("idx") % 50).alias("work_id"), F.struct("idx", "id").alias("pos"), (F.col("idx") % 10 == 3).alias("explicit"))
    return op.boundaries(rows).select("id", "boundary")
