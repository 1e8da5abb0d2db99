"""Queries of operators/lookups.py: scans, joins, searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import lookups as op
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()


def _chapters(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return view(spark, sf_dir, "kb_chapters").select(F.col("id").alias("chapter_id"), *columns)


@query("SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY idx NULLS FIRST, id) - 1 AS position FROM {kb_chapters}")
def chapters_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter positions of every book"""
    rows = view(spark, sf_dir, "kb_chapters").select("book_id", "id", "idx")
    return op.positions(rows, "book_id", [F.col("idx"), F.col("id")]).drop("idx")


@query("SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY canonical_name NULLS FIRST, id) - 1 AS position FROM {kb_entities}")
def entities_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6"""
    rows = view(spark, sf_dir, "kb_entities").select("book_id", "id", "canonical_name")
    return op.positions(rows, "book_id", [F.col("canonical_name"), F.col("id")]).drop("canonical_name")


@query("SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY name NULLS FIRST, id) - 1 AS position FROM {kb_rules}")
def rules_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7"""
    rows = view(spark, sf_dir, "kb_rules").select("book_id", "id", "name")
    return op.positions(rows, "book_id", [F.col("name"), F.col("id")]).drop("name")


@query("SELECT c.id, c.title, c.status FROM {kb_chapters} c WHERE c.id IN (SELECT record_id FROM kb_deletions WHERE table_name = 'chapters')")
def chapters_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8"""
    wanted = view(spark, sf_dir, "kb_deletions", "table_name = 'chapters'").select(F.col("record_id").alias("id"))
    return view(spark, sf_dir, "kb_chapters").join(wanted, "id", "left_semi").select("id", "title", "status")


@query("""
SELECT d.table_name, d.record_id, c.title AS shown, c.idx FROM kb_deletions d JOIN {kb_chapters} c ON d.table_name = 'chapters' AND c.id = d.record_id
UNION ALL SELECT d.table_name, d.record_id, e.canonical_name, NULL FROM kb_deletions d JOIN {kb_entities} e ON d.table_name = 'entities' AND e.id = d.record_id
UNION ALL SELECT d.table_name, d.record_id, concat_ws(': ', e.canonical_name, m.fact), c.idx FROM kb_deletions d JOIN {kb_mentions} m ON d.table_name = 'mentions' AND m.id = d.record_id
  LEFT JOIN {kb_entities} e ON e.id = m.entity_id LEFT JOIN {kb_chapters} c ON c.id = m.chapter_id
UNION ALL SELECT d.table_name, d.record_id, concat_ws(': ', h.who, h.what), c.idx FROM kb_deletions d JOIN {kb_happenings} h ON d.table_name = 'kb_events' AND h.id = d.record_id LEFT JOIN {kb_chapters} c ON c.id = h.chapter_id AND c.book_id = h.book_id
UNION ALL SELECT 'foreshadowing', d.record_id, f.hint, NULL FROM kb_deletions d JOIN {kb_foreshadowing} f ON d.table_name = 'kb_events' AND f.id = concat('f-', d.record_id)
UNION ALL SELECT 'rules', d.record_id, concat_ws(': ', r.name, r.body), NULL FROM kb_deletions d JOIN {kb_rules} r ON d.table_name = 'entities' AND r.id = d.record_id""")
def records_by_table_and_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, C15"""
    log = view(spark, sf_dir, "kb_deletions").select("table_name", "record_id")
    names = view(spark, sf_dir, "kb_entities").select(F.col("id").alias("entity_id"), "canonical_name")
    mentions = view(spark, sf_dir, "kb_mentions").join(names, "entity_id", "left").join(_chapters(spark, sf_dir, "idx"), "chapter_id", "left")
    shown = [
        ("chapters", view(spark, sf_dir, "kb_chapters").select(F.col("id").alias("record_id"), F.col("title").alias("shown"), "idx")),
        ("entities", view(spark, sf_dir, "kb_entities").select(F.col("id").alias("record_id"), F.col("canonical_name").alias("shown"), F.lit(None).cast("int").alias("idx"))),
        ("mentions", mentions.select(F.col("id").alias("record_id"), F.concat_ws(": ", "canonical_name", "fact").alias("shown"), "idx")),
    ]
    at = _chapters(spark, sf_dir, "book_id", "idx")
    events = view(spark, sf_dir, "kb_happenings").join(at, ["chapter_id", "book_id"], "left")
    shown.append(("kb_events", events.select(F.col("id").alias("record_id"), F.concat_ws(": ", "who", "what").alias("shown"), "idx")))
    none = F.lit(None).cast("int").alias("idx")
    plain = F.substring("id", 3, 1 << 20).alias("record_id")
    others = [
        ("kb_events", "foreshadowing", view(spark, sf_dir, "kb_foreshadowing").select(plain, F.col("hint").alias("shown"), none)),
        ("entities", "rules", view(spark, sf_dir, "kb_rules").select(F.col("id").alias("record_id"), F.concat_ws(": ", "name", "body").alias("shown"), none)),
    ]
    more = [log.where(F.col("table_name") == t).join(rows, "record_id").select(F.lit(name).alias("table_name"), "record_id", "shown", "idx") for t, name, rows in others]
    return reduce(DataFrame.union, more + list(log.where(F.col("table_name") == t).join(rows, "record_id").select("table_name", "record_id", "shown", "idx") for t, rows in shown))


@query("SELECT m.id, m.entity_id, c.idx, c.title FROM {kb_mentions} m LEFT JOIN {kb_chapters} c ON c.id = m.chapter_id")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1"""
    return view(spark, sf_dir, "kb_mentions").join(_chapters(spark, sf_dir, "idx", "title"), "chapter_id", "left").select("id", "entity_id", "idx", "title")


@query("SELECT m.id, m.chapter_id, e.canonical_name, e.type FROM {kb_mentions} m JOIN {kb_entities} e ON e.id = m.entity_id")
def chapter_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J19, J13"""
    names = view(spark, sf_dir, "kb_entities").select(F.col("id").alias("entity_id"), "canonical_name", "type")
    return view(spark, sf_dir, "kb_mentions").join(names, "entity_id").select("id", "chapter_id", "canonical_name", "type")


@query("""
SELECT h.id, coalesce(m.story_order, c.idx * 1000) AS sort_order, coalesce(m.lane, 0) AS lane, c.idx, m.segment_id
FROM {kb_happenings} h LEFT JOIN {kb_chapters} c ON c.id = h.chapter_id AND c.book_id = h.book_id LEFT JOIN {kb_timeline_meta} m ON m.event_id = h.id""")
def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, O3"""
    meta = view(spark, sf_dir, "kb_timeline_meta").select(F.col("event_id").alias("id"), "story_order", "lane", "segment_id")
    rows = view(spark, sf_dir, "kb_happenings").join(_chapters(spark, sf_dir, "book_id", "idx"), ["chapter_id", "book_id"], "left").join(meta, "id", "left")
    return rows.select("id", F.coalesce("story_order", F.col("idx") * 1000).alias("sort_order"), F.coalesce("lane", F.lit(0)).alias("lane"), "idx", "segment_id")


@query("SELECT f.id, f.hint, f.status, c.idx FROM {kb_foreshadowing} f LEFT JOIN {kb_chapters} c ON c.id = f.hint_chapter_id WHERE f.status = 'open'")
def open_foreshadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, P2"""
    hints = view(spark, sf_dir, "kb_foreshadowing", "status = 'open'").withColumnRenamed("hint_chapter_id", "chapter_id")
    return hints.join(_chapters(spark, sf_dir, "idx"), "chapter_id", "left").select("id", "hint", "status", "idx")


@query("""
SELECT m.chapter_id, r.id AS rule_id, r.name, m.evidence, c.idx AS first_idx FROM {kb_rule_mentions} m JOIN {kb_rules} r ON r.id = m.rule_id LEFT JOIN {kb_chapters} c ON c.id = r.first_chapter_id WHERE m.chapter_id IS NOT NULL
UNION ALL
SELECT r.first_chapter_id, r.id, r.name, NULL, c.idx FROM {kb_rules} r LEFT JOIN {kb_chapters} c ON c.id = r.first_chapter_id
WHERE r.first_chapter_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {kb_rule_mentions} m WHERE m.rule_id = r.id AND m.chapter_id = r.first_chapter_id)""")
def rules_of_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With rules first seen in a chapter that have no mention there"""
    return chapter_rules(spark, sf_dir).select("chapter_id", "rule_id", "name", "evidence", "first_idx")


def chapter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter_id, rule_id, name, body, evidence, first_idx)"""
    firsts = _chapters(spark, sf_dir, F.col("idx").alias("first_idx")).withColumnRenamed("chapter_id", "first_chapter_id")
    rules = view(spark, sf_dir, "kb_rules").select(F.col("id").alias("rule_id"), "name", "body", "first_chapter_id").join(firsts, "first_chapter_id", "left")
    mentions = view(spark, sf_dir, "kb_rule_mentions").select("rule_id", "chapter_id", "evidence")
    seen = mentions.join(rules, "rule_id").where("chapter_id IS NOT NULL").select("chapter_id", "rule_id", "name", "body", "evidence", "first_idx")
    legacy = rules.where(F.col("first_chapter_id").isNotNull()).withColumnRenamed("first_chapter_id", "chapter_id").join(mentions, ["rule_id", "chapter_id"], "left_anti")
    return seen.union(legacy.select("chapter_id", "rule_id", "name", "body", F.lit(None).cast("string"), "first_idx"))


@query("""
SELECT book_id, name, coalesce(min(CASE WHEN rank = 0 THEN entity_id END), min(entity_id)) AS entity_id FROM (
  SELECT book_id, canonical_name AS name, id AS entity_id, 0 AS rank FROM {kb_entities} WHERE canonical_name IS NOT NULL
  UNION ALL SELECT book_id, alias_raw, entity_id, 1 FROM {kb_aliases} WHERE alias_raw IS NOT NULL) GROUP BY book_id, name""")
def entities_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name or alias in use, looked up"""
    entities, aliases = view(spark, sf_dir, "kb_entities"), view(spark, sf_dir, "kb_aliases")
    wanted = entities.select("book_id", F.col("canonical_name").alias("name")).union(aliases.select("book_id", "alias_raw"))
    return op.names_to_entities(wanted, entities, aliases)


@query("""
SELECT DISTINCT CAST(d.doc_id AS VARCHAR) AS text_id, n.id AS entity_id FROM documents d JOIN (
  SELECT book_id, id, canonical_name AS name FROM {kb_entities} UNION SELECT book_id, entity_id, alias_raw FROM {kb_aliases}) n
ON n.book_id = d.book_id AND trim(n.name, ' ') <> '' AND contains(lower(d.text), lower(n.name))""")
def entities_named_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11"""
    names = view(spark, sf_dir, "kb_entities").select("book_id", F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    names = names.union(view(spark, sf_dir, "kb_aliases").select("book_id", "entity_id", "alias_raw")).distinct()
    texts = view(spark, sf_dir, "documents").select("book_id", F.col("doc_id").cast("string").alias("text_id"), "text")
    return op.names_in_texts(names, texts)


_FACTS = "(SELECT m.id, m.entity_id, m.chapter_id, c.idx FROM {kb_mentions} m JOIN {kb_chapters} c ON c.id = m.chapter_id WHERE m.entity_id IS NOT NULL)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "kb_mentions", "entity_id IS NOT NULL").select("id", "entity_id", "chapter_id")
    return rows.join(_chapters(spark, sf_dir, "idx"), "chapter_id")


def _ranked_pairs(test: str, order: str, limit: int) -> str:
    return f"""
SELECT entity_id, chapter_id, mention_id FROM (
  SELECT b.entity_id, b.chapter_id, f.id AS mention_id, row_number() OVER (PARTITION BY b.entity_id, b.chapter_id ORDER BY {order}) AS n
  FROM (SELECT DISTINCT entity_id, chapter_id, idx FROM {_FACTS}) b JOIN {_FACTS} f ON f.entity_id = b.entity_id AND {test}) WHERE n <= {limit}"""


@query(_ranked_pairs("(f.idx, f.chapter_id) < (b.idx, b.chapter_id)", "f.idx DESC, f.chapter_id DESC, f.id DESC", 3))
def facts_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest facts before each chapter, of each entity in it"""
    return op.recent_before(_facts(spark, sf_dir), 3)


@query(_ranked_pairs("f.chapter_id <> b.chapter_id", "f.idx, f.chapter_id, f.id", 15))
def facts_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14"""
    return op.elsewhere(_facts(spark, sf_dir), 15)


@query("""
SELECT kind, id, shown, CAST(rank AS INT) AS rank FROM (
  (SELECT 0 AS rank, 'entity' AS kind, id, concat_ws(' | ', canonical_name, type) AS shown FROM {kb_entities} WHERE contains(lower(concat_ws(' ', canonical_name, type)), '月') ORDER BY id LIMIT 300)
  UNION ALL (SELECT 1, 'mention', id, fact FROM {kb_mentions} WHERE contains(lower(concat_ws(' ', fact, snippet)), '月') ORDER BY id LIMIT 300)
  UNION ALL (SELECT 2, 'event', id, concat_ws(' | ', what, who) FROM {kb_happenings} WHERE contains(lower(concat_ws(' ', who, what, consequence)), '月') ORDER BY id LIMIT 300)
  UNION ALL (SELECT 3, 'foreshadowing', id, hint FROM {kb_foreshadowing} WHERE contains(lower(concat_ws(' ', hint, resolution)), '月') ORDER BY id LIMIT 300)
  UNION ALL (SELECT 4, 'rule', id, name FROM {kb_rules} WHERE contains(lower(concat_ws(' ', name, body)), '月') ORDER BY id LIMIT 300)) ORDER BY rank, id LIMIT 300""")
def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k search over five kinds"""
    kinds = [
        ("entity", view(spark, sf_dir, "kb_entities"), ["canonical_name", "type"], ["canonical_name", "type"]),
        ("mention", view(spark, sf_dir, "kb_mentions"), ["fact", "snippet"], ["fact"]),
        ("event", view(spark, sf_dir, "kb_happenings"), ["who", "what", "consequence"], ["what", "who"]),
        ("foreshadowing", view(spark, sf_dir, "kb_foreshadowing"), ["hint", "resolution"], ["hint"]),
        ("rule", view(spark, sf_dir, "kb_rules"), ["name", "body"], ["name"]),
    ]
    return op.lookup(kinds, "月", 300)
