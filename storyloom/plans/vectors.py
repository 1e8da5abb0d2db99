"""Queries of operators/vectors.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators import predicates
from storyloom.operators import vectors as op
from storyloom.plans.base import registry
from storyloom.session import written
from storyloom.sources.views import view

QUERIES, SQL, query = registry()
K = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))"
_DIST = f"round(1 - greatest(-1, least(1, {_DOT} / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x))))), 6)"


@query(f"""
SELECT query_id, vec_id, distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_DIST} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS INT) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) WHERE rank <= {K}""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows with ids divisible by 50, against all rows"""
    rows = _vectors(spark, sf_dir).drop("label")
    return op.nearest(rows.where("id % 50 = 0"), rows, K).withColumn("distance", F.round("distance", 6))


@query(f"""
SELECT query_id, vec_id, distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_DIST} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS INT) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.label IN (1, 2, 3)) WHERE rank <= {K}""")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, P5: among vectors whose metadata match"""
    rows = _vectors(spark, sf_dir)
    meta = F.create_map(F.lit("source_type"), F.col("label").cast("string"))
    allowed = rows.where(predicates.metadata_matches({"source_type": {"$in": ["1", "2", "3"]}}, meta)).drop("label")
    return op.nearest(rows.drop("label").where("id % 50 = 0"), allowed, K).withColumn("distance", F.round("distance", 6))


@query(f"""
SELECT h.query_id, h.rank, v.vec_id, v.label FROM (SELECT q.vec_id AS query_id, v.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS INT) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) h JOIN embeddings v ON v.vec_id = h.vec_id WHERE h.rank <= {K}""")
def hits_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of hits, with the rank of the hit"""
    rows = _vectors(spark, sf_dir)
    hits = op.nearest(rows.drop("label").where("id % 50 = 0"), rows.drop("label"), K)
    return hits.join(rows.select(F.col("id").alias("vec_id"), "label"), "vec_id").select("query_id", "rank", "vec_id", "label")


@query("SELECT vec_id AS query_id, true AS found FROM embeddings WHERE vec_id % 50 = 0 AND len(embedding) > 0")
def knn_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: whether the approximate search finds nine of ten of each query's true neighbours (knn_exact)"""
    rows = _vectors(spark, sf_dir).drop("label")
    asked = rows.where("id % 50 = 0")
    exact, near = (f(asked, rows, K).select("query_id", "vec_id") for f in (op.nearest, op.nearest_by_codes))
    hits = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("found"))


@query(f"SELECT vec_id FROM embeddings WHERE len(embedding) > 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0")
def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: every seventh made not a number, every eleventh zero, are refused"""
    rows = _vectors(spark, sf_dir)
    spoilt = F.when(F.col("id") % 7 == 0, F.transform("vector", lambda x: F.lit(float("nan")).cast("float"))).when(F.col("id") % 11 == 0, F.transform("vector", lambda x: F.lit(0).cast("float"))).otherwise(F.col("vector"))
    return rows.withColumn("vector", spoilt).where(op.valid(F.col("vector"))).select(F.col("id").alias("vec_id"))


_C = "coalesce({0}, '')"
_MORE = "CASE WHEN coalesce({1}, '') <> '' THEN concat(' {0}: ', {1}) ELSE '' END"
_CHUNKS = f"""(
  SELECT concat('ch_summary_', id) AS id, 'chapter_summary' AS source_type, id AS source_id, concat('章节: ', coalesce(title, ''), chr(10), summary) AS text FROM {{kb_chapters}} WHERE status = 'done' AND coalesce(summary, '') <> ''
  UNION ALL SELECT concat('ent_', e.id, CASE WHEN f.part > 0 THEN concat('_', CAST(f.part AS VARCHAR)) ELSE '' END), 'entity', e.id, concat('实体: ', coalesce(e.canonical_name, ''), ' (', coalesce(e.type, ''), ')', chr(10), f.lines) FROM {{kb_entities}} e JOIN (
    SELECT entity_id, part, string_agg(line, '' ORDER BY n) AS lines FROM (SELECT m.entity_id, concat('- [', coalesce(c.title, '?'), '] ', coalesce(m.fact, ''), chr(10)) AS line, n, n // 200 AS part FROM (
      SELECT m.*, row_number() OVER (PARTITION BY m.entity_id ORDER BY c.idx NULLS FIRST, m.id) - 1 AS n FROM {{kb_mentions}} m LEFT JOIN {{kb_chapters}} c ON c.id = m.chapter_id) m LEFT JOIN {{kb_chapters}} c ON c.id = m.chapter_id) GROUP BY ALL) f ON f.entity_id = e.id
  UNION ALL SELECT concat('ev_', h.id), 'event', h.id, concat('事件: 第', coalesce(CAST(c.idx AS VARCHAR), '?'), '章 ', {_C.format('h.who')}, ' ', {_C.format('h.what')}, {_MORE.format('地点', 'h.where_loc')}, {_MORE.format('原因', 'h.why')}, {_MORE.format('结果', 'h.consequence')}, {_MORE.format('时间', 'h.story_time')})
    FROM {{kb_happenings}} h LEFT JOIN {{kb_chapters}} c ON c.id = h.chapter_id AND c.book_id = h.book_id
  UNION ALL SELECT concat('fs_', id), 'foreshadowing', id, concat(CASE WHEN status = 'open' THEN '伏笔 [未解]: ' ELSE '伏笔 [已解]: ' END, coalesce(hint, ''), CASE WHEN coalesce(resolution, '') <> '' THEN concat(' → 回收: ', resolution) ELSE '' END) FROM {{kb_foreshadowing}}
  UNION ALL SELECT concat('rule_', id), 'rule', id, concat('规则: ', coalesce(name, ''), ': ', coalesce(body, '')) FROM {{kb_rules}})"""


def _kb(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = lambda n: view(spark, sf_dir, n)
    return {"chapters": v("kb_chapters"), "entities": v("kb_entities"), "mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing"), "rules": v("kb_rules")}


@query(f"SELECT id, source_type, source_id, sha256(text) AS content_hash FROM {_CHUNKS}")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all five sources"""
    return op.chunk_texts(_kb(spark, sf_dir)).select("id", "source_type", "source_id", "content_hash")


# What was embedded before, by the first digit of a chunk's hash: 0-3 another text, 4-5 by another backend, 6 not at all, 7 now gone; all else is as it should be.
_WAS = f"""(SELECT CASE WHEN substr(h, 1, 1) = '7' THEN concat('old_', id) ELSE id END AS id, CASE WHEN substr(h, 1, 1) < '4' THEN 'stale' ELSE h END AS content_hash, CASE WHEN substr(h, 1, 1) IN ('4', '5') THEN 'model' ELSE 'hash384' END AS backend_id
  FROM (SELECT id, sha256(text) AS h FROM {_CHUNKS}) WHERE substr(h, 1, 1) <> '6')"""


def _was(chunks: DataFrame) -> DataFrame:
    digit, h = F.substring("content_hash", 1, 1), F.col("content_hash")
    rows = chunks.where(digit != "6").select(F.when(digit == "7", F.concat(F.lit("old_"), "id")).otherwise(F.col("id")).alias("id"), F.when(digit < "4", "stale").otherwise(h).alias("content_hash"), F.when(digit.isin("4", "5"), "model").otherwise(op.HASH_BACKEND).alias("backend_id"))
    return rows


@query(f"""
SELECT c.id, CAST(CASE WHEN w.content_hash = c.h AND w.backend_id = 'hash384' THEN 2 ELSE 384 END AS INT) AS dimensions, c.h AS content_hash, 'hash384' AS backend_id
FROM (SELECT id, sha256(text) AS h FROM {_CHUNKS}) c LEFT JOIN {_WAS} w ON w.id = c.id""")
def chunks_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors (those stored before are of two dimensions here) and registry after what changed was embedded"""
    chunks = written(op.chunk_texts(_kb(spark, sf_dir)), "chunks")
    registry = _was(chunks)
    stored = registry.select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"))
    vectors, registered = op.refreshed(chunks, registry, stored)
    return vectors.join(registered, "id").select("id", F.size("vector").alias("dimensions"), "content_hash", "backend_id")


@query(f"SELECT backend_id, count(*) AS n, min(id) AS first_id FROM {_WAS} GROUP BY backend_id")
def backends_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backends vectors were made with; more than one means that those of the others are made anew"""
    return _was(op.chunk_texts(_kb(spark, sf_dir))).groupBy("backend_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""
WITH pick AS (SELECT id FROM {{kb_chapters}} WHERE status = 'done' AND coalesce(summary, '') <> '' ORDER BY id LIMIT 1)
SELECT id, source_type, sha256(text) AS content_hash FROM {_CHUNKS} k WHERE (source_type = 'chapter_summary' AND source_id IN (SELECT id FROM pick)) OR (source_type = 'entity' AND source_id IN (SELECT id FROM {{kb_entities}} WHERE first_chapter_id IN (SELECT id FROM pick)))
  OR (source_type = 'event' AND source_id IN (SELECT id FROM {{kb_happenings}} WHERE chapter_id IN (SELECT id FROM pick))) OR (source_type = 'foreshadowing' AND source_id IN (SELECT id FROM {{kb_foreshadowing}} WHERE hint_chapter_id IN (SELECT id FROM pick)))
  OR (source_type = 'rule' AND source_id IN (SELECT id FROM {{kb_rules}} WHERE first_chapter_id IN (SELECT id FROM pick)))""")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: what one chapter (a parameter, here the first that is done) has to be embedded; the same texts as for the whole book"""
    kb = _kb(spark, sf_dir)
    picked = kb["chapters"].where("status = 'done' AND coalesce(summary, '') <> ''").orderBy("id").limit(1).collect()
    return op.chunk_texts(kb, picked[0]["id"] if picked else "").select("id", "source_type", "content_hash")


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: number of features and length of every chunk's vector"""
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4)
    return op.embedded(op.chunk_texts(_kb(spark, sf_dir))).select("id", F.size("vector").alias("dimensions"), norm.alias("norm"))


@query("SELECT concat('ent_', id) AS id FROM {kb_entities} WHERE id IN (SELECT record_id FROM kb_deletions WHERE table_name = 'entities' AND action = 'delete')")
def vectors_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of entities that the log deletes"""
    entities = view(spark, sf_dir, "kb_entities").select("id")
    gone = view(spark, sf_dir, "kb_deletions", "table_name = 'entities' AND action = 'delete'").select(F.col("record_id").alias("id"))
    ent = F.concat(F.lit("ent_"), "id").alias("id")
    return op.pruned(entities.select(ent), entities.join(gone, "id", "left_anti").select(ent))


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1")
def hits_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hits for one source the first"""
    over = Window.partitionBy("label").orderBy("vec_id")
    return view(spark, sf_dir, "embeddings").select("label", "vec_id").withColumn("n", F.row_number().over(over)).where("n = 1").drop("n")


@query()
def names_resolved_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a mark added find their entity again among the three nearest of all name vectors, at a similarity of 0.86 or more; those asked are the entities whose hash is divisible by 50"""
    entities = view(spark, sf_dir, "kb_entities", "trim(canonical_name) <> ''").select(F.xxhash64("id").alias("id"), "canonical_name")
    named = lambda rows, text: op.embedded(rows.select(F.col("id").cast("string").alias("id"), text.alias("text"))).select(F.col("id").cast("bigint").alias("id"), "vector")
    stored, asked = named(entities, F.col("canonical_name")), named(entities.where("id % 50 = 0"), F.concat("canonical_name", F.lit("!")))
    return op.nearest(asked, stored, 3).where("distance <= 0.14").select("query_id", "vec_id", "rank")
