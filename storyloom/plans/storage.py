"""Queries of sources/ and streaming/ that run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.plans.base import registry
from storyloom.sources import files
from storyloom.sources.views import view
from storyloom.streaming import pipelines

QUERIES, SQL, query = registry()


@query("SELECT id, entity_id, chapter_id, fact, snippet, created_at, 0.6::DOUBLE AS confidence, 1 AS pass_no FROM {kb_mentions}")
def mentions_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: mentions written before two columns were added"""
    return schemas.migrated(view(spark, sf_dir, "kb_mentions").drop("confidence", "pass_no"), "mentions")


_NO = "CASE WHEN c.idx IS NULL THEN '?' ELSE CAST(c.idx + 1 AS VARCHAR) END"
_ALIASES = "coalesce(array_to_string(list_filter(aliases, lambda x: x IS NOT NULL), '、'), '')"
_FILE = """concat('entities/', coalesce(nullif(substr(regexp_replace(trim({0}canonical_name, ' '), '[\\\\/:*?"<>|]', '_', 'g'), 1, 100), ''), {0}id), '.md')"""


@query(f"""
WITH c AS (SELECT id, book_id, idx, title FROM {{kb_chapters}})
SELECT book_id, file, idx, key, CAST(n AS INT) AS n, line FROM (
  SELECT book_id, 'source.md' AS file, coalesce(idx, -1) AS idx, id AS key, unnest(range(4)) AS n, unnest([concat('### ', coalesce(title, '')), '', coalesce(summary, '（无摘要）'), '']) AS line FROM {{kb_chapters}}
  UNION ALL SELECT book_id, {_FILE.format('')}, -2, id, unnest(range(CASE WHEN {_ALIASES} <> '' THEN 5 ELSE 3 END)), unnest(CASE WHEN {_ALIASES} <> '' THEN [concat('# ', coalesce(canonical_name, '')), concat('类型：', coalesce(type, '')), '', concat('别名：', {_ALIASES}), ''] ELSE [concat('# ', coalesce(canonical_name, '')), concat('类型：', coalesce(type, '')), ''] END) FROM {{kb_entities}}
  UNION ALL SELECT e.book_id, {_FILE.format('e.')}, coalesce(c.idx, -1), m.id, unnest(range(CASE WHEN coalesce(m.snippet, '') <> '' THEN 5 ELSE 4 END)), unnest(CASE WHEN coalesce(m.snippet, '') <> '' THEN [concat('### 第 ', {_NO}, ' 章: ', coalesce(c.title, '')), '', concat('- ', coalesce(m.fact, '')), concat('  > ', m.snippet), ''] ELSE [concat('### 第 ', {_NO}, ' 章: ', coalesce(c.title, '')), '', concat('- ', coalesce(m.fact, '')), ''] END)
    FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id LEFT JOIN c ON c.id = m.chapter_id
  UNION ALL SELECT h.book_id, 'timeline.md', coalesce(c.idx, -1), h.id, 0, concat('- **第 ', {_NO}, ' 章** (', coalesce(story_time, ''), '): ', coalesce(who, ''), ' — ', coalesce(what, ''), CASE WHEN coalesce(where_loc, '') <> '' THEN concat('（地点：', where_loc, '）') ELSE '' END) FROM {{kb_happenings}} h LEFT JOIN c ON c.id = h.chapter_id
  UNION ALL SELECT f.book_id, 'foreshadowing.md', coalesce(c.idx, -1), concat(CASE WHEN f.status = 'open' THEN '0' ELSE '1' END, f.id), 0, concat('- ', coalesce(hint, ''), CASE WHEN f.status = 'open' THEN '' ELSE concat(' → ', coalesce(resolution, '')) END, '（第 ', {_NO}, ' 章）') FROM {{kb_foreshadowing}} f LEFT JOIN c ON c.id = f.hint_chapter_id)""")
def markdown_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of notes of every book"""
    v = lambda n: view(spark, sf_dir, n)
    return files.markdown_views({"chapters": v("kb_chapters"), "entities": v("kb_entities"), "mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing")})


@query("SELECT book_id, idx, concat('# ', coalesce(title, ''), chr(10), chr(10), coalesce(content, '')) AS value FROM {kb_texts}")
def chapters_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14"""
    return files.markdown_lines(view(spark, sf_dir, "kb_texts"))


@query("""
SELECT chapter_id, 2 AS parts, 'part one' AS first_title FROM {kb_texts} WHERE chapter_id IS NOT NULL AND trim(replace(replace(coalesce(content, ''), chr(10), ' '), chr(13), ' ')) <> '' AND NOT regexp_matches(coalesce(content, ''), '(^|[\n\r])[ \t　]*(#|第|[Cc][Hh][Aa][Pp])')""")
def text_split_at_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters written one after another, cut again at their headings; the SQL leaves out texts that hold headings"""
    content = F.coalesce("content", F.lit(""))
    known = view(spark, sf_dir, "kb_texts", "chapter_id IS NOT NULL").where(F.trim(F.translate(content, "\n\r", "  ")) != "")
    book = F.concat(F.lit("# part one\n"), content, F.lit("\n## part two\n"), content)
    parts = files.split_chapters(book)
    return known.select("chapter_id", F.size(parts).alias("parts"), F.get(parts, F.lit(0))["title"].alias("first_title"))


@query("SELECT *, bytes > 100000 AS over FROM (SELECT source AS tenant, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM documents GROUP BY source)")
def tenant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20"""
    return files.usage(view(spark, sf_dir, "documents").select(F.col("source").alias("tenant"), F.octet_length("text").alias("length")), 100_000)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the batch form of the windowed stream"""
    rows = pipelines.windowed_counts(view(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the batch form of the session stream"""
    return pipelines.sessions(view(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
