"""Queries of operators/predicates.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import STRIPPED_SQL, stripped
from storyloom.operators import predicates as op
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()
FILTER = {"$or": [{"source_type": {"$in": ["1", "2", "3"]}, "parity": {"$ne": "0"}}, {"source_type": "7", "missing": None}], "ignored": "x"}
NAMES = ["洛", "Grim", "·"]


@query("SELECT vec_id FROM embeddings WHERE (label IN (1, 2, 3) AND vec_id % 2 <> 0) OR label = 7")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5"""
    rows = view(spark, sf_dir, "embeddings").select("vec_id", F.create_map(F.lit("source_type"), F.col("label").cast("string"), F.lit("parity"), (F.col("vec_id") % 2).cast("string")).alias("metadata"))
    return rows.where(op.metadata_matches(FILTER, F.col("metadata"))).select("vec_id")


_TYPE = "coalesce(nullif({0}, ''), '未分类')"
_SAME_CLASS = """(({a} IN ('地点', '场所') AND {b} IN ('地点', '场所')) OR ({a} IN ('势力', '组织', '阵营') AND {b} IN ('势力', '组织', '阵营'))
  OR ({a} IN ('物品', '道具') AND {b} IN ('物品', '道具')) OR ({a} IN ('规则', '设定') AND {b} IN ('规则', '设定')))"""


def compatible_sql(a: str, b: str) -> str:
    """Whether two types go together, for DuckDB."""
    a, b = _TYPE.format(a), _TYPE.format(b)
    return f"({a} = {b} OR {a} IN ('未分类', '未知') OR {b} IN ('未分类', '未知') OR {_SAME_CLASS.format(a=a, b=b)})"


_OTHERS = ("人物", "地点", "场所", "势力", "组织", "阵营", "物品", "道具", "事件", "规则", "设定", "功法", "未知")


@query(f"""
SELECT id, type AS own_type, type AS other_type, {compatible_sql('type', 'type')} AS compatible FROM {{kb_entities}}
UNION ALL SELECT e.id, e.type, t.label, {compatible_sql('e.type', 't.label')} FROM {{kb_entities}} e CROSS JOIN (SELECT label FROM entity_types UNION SELECT unnest({list(_OTHERS)})) t""")
def compatible_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity's type against itself and some forty known words, which travel as one array"""
    labels = sorted({r["label"] for r in view(spark, sf_dir, "entity_types").select("label").collect()} | set(_OTHERS))
    pairs = view(spark, sf_dir, "kb_entities").select("id", F.col("type").alias("own_type"), F.explode(F.concat(F.array("type"), F.array(*map(F.lit, labels)))).alias("other_type"))
    return pairs.withColumn("compatible", op.types_compatible(F.col("own_type"), F.col("other_type")))


@query("SELECT id, severity FROM {kb_alerts} WHERE status = 'open' AND kind = 'character'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, M11 (list)"""
    return view(spark, sf_dir, "kb_alerts", op.all_of(status="open", kind="character", severity=None)).select("id", "severity")


@query("SELECT h.id, h.who, c.idx FROM {kb_happenings} h LEFT JOIN {kb_chapters} c ON c.id = h.chapter_id AND c.book_id = h.book_id WHERE " + " OR ".join(f"contains(lower(h.who), '{n.lower()}')" for n in NAMES))
def events_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, J3"""
    chapters = view(spark, sf_dir, "kb_chapters").select(F.col("id").alias("chapter_id"), "book_id", "idx")
    return view(spark, sf_dir, "kb_happenings", op.mentions_any(F.col("who"), NAMES)).join(chapters, ["chapter_id", "book_id"], "left").select("id", "who", "idx")


@query("SELECT id, canonical_name FROM {kb_entities} WHERE id NOT IN (SELECT entity_id FROM mentions WHERE entity_id IS NOT NULL)")
def remaining_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities no mention names"""
    named = view(spark, sf_dir, "mentions").select(F.col("entity_id").alias("id")).distinct()
    return view(spark, sf_dir, "kb_entities").join(named, "id", "left_anti").select("id", "canonical_name")


@query("SELECT id, idx, summary FROM {kb_chapters} WHERE coalesce(summary, '') <> ''")
def summarised_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6"""
    return view(spark, sf_dir, "kb_chapters", F.coalesce("summary", F.lit("")) != "").select("id", "idx", "summary")


@query("SELECT book_id, count(*) AS done FROM {kb_chapters} WHERE status IN ('done', 'skipped') GROUP BY book_id")
def done_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, A4"""
    return view(spark, sf_dir, "kb_chapters", F.col("status").isin("done", "skipped")).groupBy("book_id").agg(F.count("*").alias("done"))


_FIELDS = ("canonical_name", "type", "aliases", "first_chapter_id", "fact", "snippet", "chapter_id", "confidence", "who", "what", "why", "created_at", "title", "summary", "idx")
_LOGGED = "CASE table_name WHEN 'kb_events' THEN 'events' ELSE table_name END"


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "kb_deletions").withColumn("table_name", F.when(F.col("table_name") == "kb_events", "events").otherwise(F.col("table_name")))


@query(f"""
SELECT d.id, d.table_name, d.record_id, f.field FROM (SELECT id, {_LOGGED} AS table_name, record_id FROM kb_deletions) d CROSS JOIN (SELECT unnest({list(_FIELDS)}) AS field) f
WHERE (d.table_name = 'entities' AND f.field IN ('canonical_name', 'type', 'aliases', 'first_chapter_id')) OR (d.table_name = 'mentions' AND f.field IN ('fact', 'snippet', 'chapter_id'))
  OR (d.table_name = 'events' AND f.field IN ('story_time', 'who', 'what', 'where_loc', 'why', 'consequence', 'chapter_id'))
  OR (d.table_name = 'foreshadowing' AND f.field IN ('hint', 'status', 'resolved_chapter_id', 'resolution', 'hint_chapter_id')) OR (d.table_name = 'rules' AND f.field IN ('name', 'body', 'first_chapter_id'))""")
def editable_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of fifteen fields of every logged record may be edited"""
    fields = F.explode(F.array(*map(F.lit, _FIELDS))).alias("field")
    return op.editable(_logged(spark, sf_dir).select("id", "table_name", "record_id", fields))


@query(f"""
SELECT d.id, d.table_name, d.record_id, CASE d.table_name WHEN 'entities' THEN EXISTS (SELECT 1 FROM {{kb_entities}} x WHERE x.id = d.record_id) WHEN 'events' THEN EXISTS (SELECT 1 FROM {{kb_happenings}} x WHERE x.id = d.record_id)
  WHEN 'mentions' THEN EXISTS (SELECT 1 FROM {{kb_mentions}} x JOIN {{kb_entities}} e ON e.id = x.entity_id WHERE x.id = d.record_id) ELSE false END AS known
FROM (SELECT id, {_LOGGED} AS table_name, record_id FROM kb_deletions) d""")
def existing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, J19"""
    v = lambda n: view(spark, sf_dir, n)
    tables = {"entities": v("kb_entities"), "mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing"), "rules": v("kb_rules")}
    return op.existing(_logged(spark, sf_dir).select("id", "table_name", "record_id"), tables)


@query(f"SELECT chapter_id, idx FROM {{kb_texts}} WHERE length({STRIPPED_SQL.format('content')}) >= 80")
def checkable_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11"""
    return view(spark, sf_dir, "kb_texts", F.length(stripped(F.col("content"))) >= 80).select("chapter_id", "idx")


@query("SELECT id, canonical_name FROM {kb_entities} WHERE type = '人物'")
def entities_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12"""
    return view(spark, sf_dir, "kb_entities", op.all_of(type="人物")).select("id", "canonical_name")


@query("""
SELECT t.chapter_id, NOT EXISTS (SELECT 1 FROM chapters c WHERE c.id = t.chapter_id AND c.status = 'done'
  AND c.content_hash = CASE WHEN coalesce(t.content, '') = '' THEN '' ELSE sha256(t.content) END) AS changed FROM {kb_texts} t""")
def chapter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, F2, J15"""
    return op.hash_gate(view(spark, sf_dir, "chapters"), view(spark, sf_dir, "kb_texts"))


_CHUNK = "sha256(concat(coalesce(canonical_name, ''), '|', coalesce(type, '')))"


@query(f"SELECT id FROM {{kb_entities}} WHERE aliases IS NULL OR {_CHUNK} <> CASE WHEN updated_at % 2 = 0 THEN {_CHUNK} ELSE 'stale' END")
def chunk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14"""
    chunks = view(spark, sf_dir, "kb_entities").select("id", F.sha2(F.concat_ws("|", F.coalesce("canonical_name", F.lit("")), F.coalesce("type", F.lit(""))), 256).alias("content_hash"), F.lit("hash384").alias("backend_id"), "updated_at", "aliases")
    registry = chunks.where("aliases IS NOT NULL").withColumn("content_hash", F.when(F.col("updated_at") % 2 == 0, F.col("content_hash")).otherwise("stale")).drop("updated_at", "aliases")
    return op.new_chunks(chunks, registry).select("id")


@query("""
SELECT c.id AS chapter_id, f.id FROM (SELECT DISTINCT id FROM chapters) c JOIN {kb_foreshadowing} f ON f.hint_chapter_id = c.id OR f.resolved_chapter_id = c.id""")
def hints_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted or resolved in a chapter, as two keys of one equi-join"""
    hints = view(spark, sf_dir, "kb_foreshadowing").select("id", F.explode(F.array_distinct(F.array("hint_chapter_id", "resolved_chapter_id"))).alias("chapter_id"))
    chapters = view(spark, sf_dir, "chapters").select(F.col("id").alias("chapter_id")).distinct()
    return hints.join(chapters, "chapter_id").select("chapter_id", "id")


_S = STRIPPED_SQL.format


@query(f"""
SELECT 'mention' AS kind, id, {_S('fact')} AS said FROM {{kb_mentions}} WHERE {_S('fact')} <> '' UNION ALL SELECT 'event', id, {_S('what')} FROM {{kb_happenings}} WHERE {_S('what')} <> ''
UNION ALL SELECT 'entity', id, {_S('canonical_name')} FROM {{kb_entities}} WHERE {_S('canonical_name')} <> '' UNION ALL SELECT 'foreshadowing', id, {_S('hint')} FROM {{kb_foreshadowing}} WHERE {_S('hint')} <> ''
UNION ALL SELECT 'rule', id, {_S('name')} FROM {{kb_rules}} WHERE {_S('name')} <> '' AND {_S('body')} <> ''""")
def filled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, events, names, hints and rules (name and body) that say something"""
    filled = lambda c: stripped(F.col(c)) != ""
    kinds = (("mention", "kb_mentions", "fact", filled("fact")), ("event", "kb_happenings", "what", filled("what")), ("entity", "kb_entities", "canonical_name", filled("canonical_name")), ("foreshadowing", "kb_foreshadowing", "hint", filled("hint")), ("rule", "kb_rules", "name", filled("name") & filled("body")))
    return reduce(DataFrame.union, (view(spark, sf_dir, t, test).select(F.lit(k).alias("kind"), "id", stripped(F.col(c)).alias("said")) for k, t, c, test in kinds))


_HAY = "lower(concat(coalesce(c.title, ''), ' ', coalesce(c.summary, ''), ' ', coalesce(t.tags, ''), ' ', coalesce(p.content, '')))"


@query(f"""
SELECT c.id FROM {{kb_chapters}} c LEFT JOIN (SELECT chapter_id, string_agg(DISTINCT canonical_name, ' ' ORDER BY canonical_name) AS tags FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id GROUP BY chapter_id) t ON t.chapter_id = c.id
LEFT JOIN (SELECT chapter_id, string_agg(content, ' ' ORDER BY content) AS content FROM {{kb_texts}} GROUP BY chapter_id) p ON p.chapter_id = c.id WHERE contains({_HAY}, '旧约')""")
def chapter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In title, summary, tags (the names mentioned in a chapter) and paragraphs"""
    names = view(spark, sf_dir, "kb_entities").select(F.col("id").alias("entity_id"), "canonical_name")
    tags = view(spark, sf_dir, "kb_mentions").select("entity_id", "chapter_id").distinct().join(names, "entity_id").select(F.col("chapter_id").alias("id"), F.col("canonical_name").alias("part"))
    texts = view(spark, sf_dir, "kb_texts").select(F.col("chapter_id").alias("id"), F.col("content").alias("part"))
    return op.searched(view(spark, sf_dir, "kb_chapters").select("id", "title", "summary"), ["title", "summary"], [tags, texts], "旧约").select("id")
