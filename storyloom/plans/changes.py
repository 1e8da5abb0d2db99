"""Queries of operators/changes.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions.prefix import running
from storyloom.operators import changes as op
from storyloom.operators.ingest import merges_recorded as merges_of
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()


@query("""
SELECT coalesce(c.id, t.chapter_id) AS id, coalesce(t.title, c.title) AS title, coalesce(c.status, 'pending') AS status, coalesce(t.idx, c.idx) AS idx, coalesce(c.tokens_used, 0) AS tokens_used
FROM (SELECT id, min(title) AS title, min(status) AS status, min(idx) AS idx, min(tokens_used) AS tokens_used FROM {kb_chapters} WHERE id IS NOT NULL GROUP BY id) c
FULL OUTER JOIN (SELECT chapter_id, max(title) AS title, max(idx) AS idx FROM {kb_texts} WHERE chapter_id IS NOT NULL GROUP BY chapter_id) t ON t.chapter_id = c.id""")
def chapters_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: chapters take title and index of their files; null keeps"""
    old = view(spark, sf_dir, "kb_chapters", "id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"), F.min("status").alias("status"), F.min("idx").alias("idx"), F.min("tokens_used").alias("tokens_used"))
    new = view(spark, sf_dir, "kb_texts", "chapter_id IS NOT NULL").groupBy(F.col("chapter_id").alias("id")).agg(F.max("title").alias("title"), F.max("idx").alias("idx"))
    return op.upserted(old, new, ["id"], {"status": "pending", "tokens_used": 0})


@query("""
SELECT coalesce(r.book_id, n.book_id) AS book_id, coalesce(r.name, n.name) AS name, coalesce(n.body, r.body) AS body, coalesce(r.first_chapter_id, n.first_chapter_id) AS first_chapter_id
FROM (SELECT book_id, name, min(body) AS body, min(first_chapter_id) AS first_chapter_id FROM {kb_rules} WHERE name IS NOT NULL AND book_id IS NOT NULL GROUP BY ALL) r
FULL OUTER JOIN (SELECT book_id, canonical_name AS name, concat('new ', min(id)) AS body, max(first_chapter_id) AS first_chapter_id FROM {kb_entities} WHERE type = '规则' AND canonical_name IS NOT NULL AND book_id IS NOT NULL GROUP BY ALL) n
ON n.book_id = r.book_id AND n.name = r.name""")
def rules_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, M8, M2: the body is replaced, the first chapter kept"""
    known = "name IS NOT NULL AND book_id IS NOT NULL"
    old = view(spark, sf_dir, "kb_rules", known).groupBy("book_id", "name").agg(F.min("body").alias("body"), F.min("first_chapter_id").alias("first_chapter_id"))
    new = view(spark, sf_dir, "kb_entities", "type = '规则'").withColumnRenamed("canonical_name", "name").where(known).groupBy("book_id", "name").agg(F.concat(F.lit("new "), F.min("id")).alias("body"), F.max("first_chapter_id").alias("first_chapter_id"))
    return op.upserted(old, new, ["book_id", "name"], keep=("first_chapter_id",))


@query("SELECT id, who, what FROM {kb_happenings} UNION ALL SELECT concat('new-', id), who, consequence FROM {kb_happenings} WHERE trim(consequence) <> ''")
def events_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4, M5, M14, M18"""
    events = view(spark, sf_dir, "kb_happenings")
    more = events.where(F.trim("consequence") != "").select(F.concat(F.lit("new-"), "id").alias("id"), "who", F.col("consequence").alias("what"))
    return events.select("id", "who", "what").unionByName(more)


@query("""
SELECT f.id, CASE WHEN r.hint IS NOT NULL AND f.status = 'open' THEN 'resolved' ELSE f.status END AS status, CASE WHEN r.hint IS NOT NULL AND f.status = 'open' THEN r.chapter_id ELSE f.resolved_chapter_id END AS resolved_chapter_id
FROM {kb_foreshadowing} f LEFT JOIN (SELECT book_id, what AS hint, min(chapter_id) AS chapter_id FROM {kb_happenings} WHERE where_loc IS NULL AND chapter_id IS NOT NULL GROUP BY ALL) r ON r.book_id = f.book_id AND r.hint = f.hint""")
def hints_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6"""
    said = view(spark, sf_dir, "kb_happenings", "where_loc IS NULL AND chapter_id IS NOT NULL").select("book_id", F.col("what").alias("hint"), "chapter_id", F.lit("r").alias("resolution"))
    return op.resolved(view(spark, sf_dir, "kb_foreshadowing"), said).select("id", "status", "resolved_chapter_id")


@query("SELECT id, substr(kind, 1, 50) AS kind, severity, CASE WHEN status = 'open' AND severity = 'medium' THEN 'dismissed' ELSE status END AS status FROM {kb_alerts} WHERE trim(message) <> ''")
def alerts_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank ones left out, medium ones dismissed"""
    status = F.when((F.col("status") == "open") & (F.col("severity") == "medium"), "dismissed").otherwise(F.col("status"))
    return view(spark, sf_dir, "kb_alerts", F.trim("message") != "").select("id", F.substring("kind", 1, 50).alias("kind"), "severity", status.alias("status"))


_GONE = "(SELECT record_id FROM kb_deletions WHERE table_name = 'chapters' AND action = 'delete')"


@query(f"""
SELECT 'mentions' AS tbl, id FROM {{kb_mentions}} WHERE coalesce(chapter_id NOT IN {_GONE}, true)
UNION ALL SELECT 'events', id FROM {{kb_happenings}} WHERE coalesce(chapter_id NOT IN {_GONE}, true)
UNION ALL SELECT 'foreshadowing', id FROM {{kb_foreshadowing}} WHERE coalesce(hint_chapter_id NOT IN {_GONE}, true) AND coalesce(resolved_chapter_id NOT IN {_GONE}, true)
UNION ALL SELECT 'rules', id FROM {{kb_rules}} WHERE coalesce(first_chapter_id NOT IN {_GONE}, true)
UNION ALL SELECT 'rule_mentions', m.id FROM {{kb_rule_mentions}} m WHERE coalesce(m.chapter_id NOT IN {_GONE}, true) AND m.rule_id IN (SELECT id FROM {{kb_rules}} WHERE coalesce(first_chapter_id NOT IN {_GONE}, true))
UNION ALL SELECT 'entities', id FROM {{kb_entities}} e WHERE NOT (coalesce(first_chapter_id IN {_GONE}, false) AND NOT EXISTS (SELECT 1 FROM {{kb_mentions}} m WHERE m.entity_id = e.id AND coalesce(m.chapter_id NOT IN {_GONE}, true)))""")
def chapters_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when the chapters in the deletion log go"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    gone = v("kb_deletions", "table_name = 'chapters' AND action = 'delete'").select(F.col("record_id").alias("chapter_id"))
    left = op.without_chapters({"mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing"), "rules": v("kb_rules"), "rule_mentions": v("kb_rule_mentions"), "entities": v("kb_entities")}, gone)
    out = None
    for name, rows in left.items():
        part = rows.select(F.lit(name).alias("tbl"), "id")
        out = part if out is None else out.union(part)
    return out


_MERGES = "(SELECT e.id AS from_id, t.into_id FROM {kb_entities} e JOIN (SELECT book_id, canonical_name, min(id) AS into_id FROM {kb_entities} GROUP BY ALL HAVING count(*) > 1) t ON t.book_id = e.book_id AND t.canonical_name = e.canonical_name WHERE e.id <> t.into_id)"


@query(f"""
WITH merges AS {_MERGES}, named AS (SELECT e.*, m.into_id, coalesce(m.into_id, e.id) AS target FROM {{kb_entities}} e LEFT JOIN merges m ON m.from_id = e.id),
al AS (SELECT DISTINCT target, a FROM (SELECT target, unnest(aliases) AS a FROM named UNION ALL SELECT target, canonical_name FROM named WHERE into_id IS NOT NULL) WHERE trim(a, ' ') <> ''),
lists AS (SELECT al.target, list(al.a ORDER BY encode(al.a)) AS aliases FROM al JOIN {{kb_entities}} e ON e.id = al.target WHERE al.a IS DISTINCT FROM e.canonical_name GROUP BY al.target),
counts AS (SELECT coalesce(g.into_id, m.entity_id) AS target, count(*) AS n FROM {{kb_mentions}} m LEFT JOIN merges g ON g.from_id = m.entity_id GROUP BY ALL)
SELECT n.id, n.canonical_name, coalesce(l.aliases, []) AS aliases, coalesce(n.first_chapter_id, (SELECT min(first_chapter_id) FROM named x WHERE x.target = n.id)) AS first_chapter_id, coalesce(c.n, 0) AS mention_cnt
FROM named n LEFT JOIN lists l ON l.target = n.id LEFT JOIN counts c ON c.target = n.id WHERE n.into_id IS NULL""")
def entities_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one name in one book, each merged into the one before it, become the one with the least id"""
    entities = view(spark, sf_dir, "kb_entities")
    merged, _ = op.merged_entities(entities, view(spark, sf_dir, "kb_mentions"), _chain(entities))
    return merged.select("id", "canonical_name", "aliases", "first_chapter_id", "mention_cnt")


def _chain(entities: DataFrame) -> DataFrame:
    before = F.lag("id").over(Window.partitionBy("book_id", "canonical_name").orderBy("id"))
    return entities.where("book_id IS NOT NULL AND canonical_name IS NOT NULL").select(F.col("id").alias("from_id"), before.alias("into_id")).where("into_id IS NOT NULL")


@query(f"SELECT e.book_id, e.canonical_name AS from_name, m.into_id, 'manual' AS reason FROM {_MERGES} m JOIN {{kb_entities}} e ON e.id = m.from_id")
def merges_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every merge"""
    entities = view(spark, sf_dir, "kb_entities")
    return merges_of(entities, op.followed(_chain(entities)))


@query("SELECT record_id, field, arg_max(new_value, id) AS value, count(*) AS edits FROM {kb_edits} WHERE NOT undone GROUP BY ALL")
def edits_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, G4, G6, G7"""
    return op.folded_edits(view(spark, sf_dir, "kb_edits"))


@query("""
SELECT id, record_id, field, new_value AS taken_back, old_value FROM (SELECT *, last_value(CASE WHEN NOT undone THEN new_value END IGNORE NULLS) OVER (PARTITION BY record_id, field ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_value FROM {kb_edits}) WHERE undone""")
def edits_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, D13"""
    return op.undo_entries(view(spark, sf_dir, "kb_edits"))


@query("""
SELECT d.id, d.table_name, d.record_id, 'title' AS field, c.title AS old_value, concat('proposed ', CAST(d.id AS VARCHAR)) AS new_value, CASE WHEN d.action = 'delete' THEN 'rejected' ELSE 'pending' END AS status
FROM kb_deletions d JOIN (SELECT id, min(title) AS title FROM {kb_chapters} GROUP BY id) c ON c.id = d.record_id WHERE d.table_name = 'chapters'""")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for known records with the value they would replace"""
    now = view(spark, sf_dir, "kb_chapters").groupBy(F.col("id").alias("record_id")).agg(F.min("title").alias("old_value"))
    log = view(spark, sf_dir, "kb_deletions", "table_name = 'chapters'").join(now, "record_id")
    return log.select("id", "table_name", "record_id", F.lit("title").alias("field"), "old_value", F.concat(F.lit("proposed "), F.col("id").cast("string")).alias("new_value"), F.when(F.col("action") == "delete", "rejected").otherwise("pending").alias("status"))


_QUEUE = """(SELECT user_id AS key, CASE arg_max(a, event_id) WHEN 'enqueue' THEN 'pending' WHEN 'claim' THEN 'processing' ELSE arg_max(a, event_id) END AS status, count(*) FILTER (WHERE a = 'error') AS attempts, max(CASE WHEN a = 'enqueue' THEN event_id END) AS enqueued
  FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS a FROM events) WHERE a IS NOT NULL GROUP BY user_id HAVING max(CASE WHEN a = 'enqueue' THEN event_id END) IS NOT NULL)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.create_map(*(F.lit(x) for x in ("click", "enqueue", "view", "claim", "purchase", "done", "error", "error")))
    return op.queue_state(view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.try_element_at(action, F.col("event_type")).alias("action")))


@query(f"SELECT * FROM {_QUEUE}")
def dirty_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q3, D5"""
    return _queue(spark, sf_dir)


@query(f"SELECT key, 'processing' AS status, attempts, enqueued FROM {_QUEUE} WHERE status = 'pending' ORDER BY enqueued, key LIMIT 5")
def queue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q7"""
    return op.claimed(_queue(spark, sf_dir), 5)


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id DESC) AS n FROM events) WHERE n <= 500")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 entries of each of three logs"""
    rows = view(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 3).alias("log"))
    return running(rows, ["log"], [-F.col("event_id")], {}).where("rank <= 500").select("event_id", "user_id")


@query("SELECT event_id, ts, event_type FROM (SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 50)")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, Q5"""
    return view(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("event_id")).limit(50).orderBy("event_id")


@query("""
SELECT book_id, CASE WHEN done = total THEN 'done' WHEN failed > 0 THEN 'error' WHEN done > 0 THEN 'paused' ELSE 'idle' END AS state, current_idx FROM (
  SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status IN ('done', 'skipped')) AS done, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(max(CASE WHEN status IN ('done', 'skipped') THEN idx END), -1) AS current_idx FROM {kb_chapters} GROUP BY book_id)""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19, Q4, Q6"""
    finished = F.col("status").isin("done", "skipped")
    counts = view(spark, sf_dir, "kb_chapters").groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(finished).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.max(F.when(finished, F.col("idx"))), F.lit(-1)).alias("current_idx"))
    state = F.when(F.col("done") == F.col("total"), "done").when(F.col("failed") > 0, "error").when(F.col("done") > 0, "paused").otherwise("idle")
    return counts.select("book_id", state.alias("state"), "current_idx")


@query("""
SELECT a.id, CASE WHEN a.h = b.h THEN 'skip' WHEN b.h IS NULL THEN 'adopt' WHEN a.t > b.t THEN 'replace' ELSE 'fork' END AS step FROM (SELECT id, content_hash AS h, updated_at AS t FROM {kb_chapters}) a
LEFT JOIN (SELECT chapter_id, CASE WHEN coalesce(content, '') = '' THEN '' ELSE sha256(content) END AS h, 1750000000 AS t FROM {kb_texts}) b ON b.chapter_id = a.id""")
def sync_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: what to do with each chapter of two copies of a work"""
    from storyloom.functions.text import content_hash

    other = view(spark, sf_dir, "kb_texts").select(F.col("chapter_id").alias("id"), content_hash(F.col("content")).alias("h"), F.lit(1750000000).alias("t"))
    rows = view(spark, sf_dir, "kb_chapters").join(other, "id", "left")
    step = F.when(F.col("content_hash") == F.col("h"), "skip").when(F.col("h").isNull(), "adopt").when(F.col("updated_at") > F.col("t"), "replace").otherwise("fork")
    return rows.select("id", step.alias("step"))
