"""Queries of operators/governance.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators import governance as op
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()

# a proposal for every logged record; those logged as deletions are confirmed
_PROPOSED = """(SELECT d.id, CASE table_name WHEN 'kb_events' THEN 'events' ELSE table_name END AS table_name, record_id, CASE table_name WHEN 'entities' THEN 'type' WHEN 'mentions' THEN 'fact' WHEN 'kb_events' THEN 'what' ELSE 'title' END AS field, concat('proposed ', CAST(id AS VARCHAR)) AS new_value,
  CASE WHEN action = 'delete' THEN 'pending' ELSE 'rejected' END AS status FROM kb_deletions d)"""
_KNOWN = """(SELECT 'entities' AS table_name, id AS record_id, 'type' AS field, type AS value FROM {kb_entities} UNION ALL SELECT 'mentions', m.id, 'fact', m.fact FROM {kb_mentions} m JOIN {kb_entities} e ON e.id = m.entity_id UNION ALL SELECT 'events', id, 'what', what FROM {kb_happenings})"""
_LOG = f"""(SELECT p.id, p.table_name, p.record_id, p.field, CASE WHEN lag(p.id) OVER w IS NULL THEN k.value ELSE lag(p.new_value) OVER w END AS old_value, p.new_value, 'ai-confirmed' AS source FROM {_PROPOSED} p JOIN {_KNOWN} k ON k.table_name = p.table_name AND k.record_id = p.record_id AND k.field = p.field
  WHERE p.status = 'pending' WINDOW w AS (PARTITION BY p.table_name, p.record_id, p.field ORDER BY p.id))"""


def _kb(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = lambda n: view(spark, sf_dir, n)
    return {"entities": v("kb_entities"), "mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing"), "rules": v("kb_rules")}


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("table_name")
    field = F.when(t == "entities", "type").when(t == "mentions", "fact").when(t == "kb_events", "what").otherwise("title")
    status = F.when(F.col("action") == "delete", "pending").otherwise("rejected")
    return view(spark, sf_dir, "kb_deletions").select("id", F.when(t == "kb_events", "events").otherwise(t).alias("table_name"), "record_id", field.alias("field"), F.concat(F.lit("proposed "), F.col("id").cast("string")).alias("new_value"), status.alias("status"))


def _confirmed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _proposed(spark, sf_dir)
    return op.confirmed(_kb(spark, sf_dir), rows, rows.select("id"))


@query(f"SELECT id, table_name, record_id, field, old_value, new_value, source FROM {_LOG}")
def proposals_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of confirmed proposals, each with the value it replaced when its turn came"""
    return _confirmed(spark, sf_dir)[1].drop("proposal_id")


@query(f"SELECT p.id, CASE WHEN l.id IS NOT NULL THEN 'confirmed' ELSE p.status END AS status FROM {_PROPOSED} p LEFT JOIN {_LOG} l ON l.id = p.id")
def proposal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every proposal"""
    return _confirmed(spark, sf_dir)[0].select("id", "status")


@query(f"""
SELECT m.id, CASE WHEN l.v IS NULL THEN m.fact ELSE l.v END AS fact FROM {{kb_mentions}} m LEFT JOIN (SELECT record_id, arg_max(new_value, id) AS v FROM {_LOG} WHERE table_name = 'mentions' GROUP BY ALL) l ON l.record_id = m.id""")
def facts_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts after the edits were written"""
    return op.written_back(view(spark, sf_dir, "kb_mentions"), "mentions", _confirmed(spark, sf_dir)[1]).select("id", "fact")


@query(f"""
SELECT id AS undoes, table_name, record_id, field, new_value AS old_value, old_value AS new_value, 'undo' AS source FROM {_LOG} WHERE id % 2 = 0""")
def edits_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that take every second edit back"""
    log = _confirmed(spark, sf_dir)[1].withColumn("undone", F.lit(False))
    return op.undone(log, log.where("id % 2 = 0").select("id"))[1]


@query(f"SELECT id, table_name, record_id FROM {_LOG} WHERE id % 2 <> 0 ORDER BY id DESC LIMIT 20")
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty entries that were not undone"""
    log = _confirmed(spark, sf_dir)[1].withColumn("undone", F.lit(False))
    left = op.undone(log, log.where("id % 2 = 0").select("id"))[0].where("NOT undone")
    return left.orderBy(F.desc("id")).limit(20).select("id", "table_name", "record_id")


@query("""
SELECT coalesce(s.book_id, c.book_id) AS book_id, CASE WHEN c.book_id IS NOT NULL THEN 'running' ELSE s.status END AS status, coalesce(s.current_idx, -1) AS current_idx, coalesce(c.total, s.total) AS total, coalesce(c.pause, s.pause, false) AS pause_requested
FROM (SELECT book_id, 'done' AS status, max(idx) AS current_idx, CAST(count(*) AS INT) AS total, false AS pause FROM {kb_chapters} WHERE status = 'done' AND book_id IS NOT NULL GROUP BY book_id) s
FULL OUTER JOIN (SELECT book_id, CAST(count(*) AS INT) AS total, count(*) % 2 = 0 AS pause FROM {kb_chapters} WHERE status = 'pending' AND book_id IS NOT NULL GROUP BY book_id) c ON c.book_id = s.book_id""")
def states_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of books with pending chapters are set going, some to pause; a column that may not be set is ignored"""
    rows = view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL")
    states = rows.where("status = 'done'").groupBy("book_id").agg(F.lit("done").alias("status"), F.max("idx").alias("current_idx"), F.count("*").cast("int").alias("total"), F.lit(False).alias("pause_requested"))
    changes = rows.where("status = 'pending'").groupBy("book_id").agg(F.lit("running").alias("status"), F.count("*").cast("int").alias("total"), (F.count("*") % 2 == 0).alias("pause_requested"), F.lit(1).alias("updated_at"))
    return op.states_set(states, changes)


_STATUS = "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'error' END"


@query(f"SELECT event_id AS id, CASE WHEN {_STATUS} = 'processing' THEN 'pending' ELSE {_STATUS} END AS status FROM events")
def queue_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: entries left in processing are pending again at a start"""
    status = F.create_map(*(F.lit(x) for x in ("click", "pending", "view", "processing", "purchase", "done")))
    rows = view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("error")).alias("status"))
    return op.restarted(rows)


@query("""
WITH t AS (SELECT event_id AS id, event_type = 'purchase' AS heavy, CASE WHEN event_type = 'error' THEN 'running' ELSE 'pending' END AS status FROM events), h AS (SELECT id FROM t WHERE heavy AND status = 'pending' ORDER BY id LIMIT 3)
SELECT id, status = 'pending' AND (NOT heavy OR id IN (SELECT id FROM h)) AS go FROM t""")
def tasks_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: three slots for heavy tasks, none in use"""
    kind = F.col("event_type")
    rows = view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (kind == "purchase").alias("heavy"), F.when(kind == "error", "running").otherwise("pending").alias("status"), F.col("event_id").alias("asked"))
    return op.admitted(rows, 3).select("id", "go")


@query("SELECT user_id AS run_id, right(string_agg(concat(event_type, '.'), '' ORDER BY event_id), 60) AS text FROM events GROUP BY user_id")
def run_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 characters of every run's tokens"""
    tokens = view(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("n"), F.concat("event_type", F.lit(".")).alias("token"))
    return op.buffers(tokens, 60)


_BATCHES = "(SELECT concat(book_id, '/', CAST((n - 1) // 5 AS VARCHAR)) AS batch, CAST((n - 1) % 5 AS INT) AS pos, id, idx FROM (SELECT id, book_id, idx, row_number() OVER (PARTITION BY book_id ORDER BY idx, id) AS n FROM {kb_chapters} WHERE book_id IS NOT NULL AND idx IS NOT NULL))"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL AND idx IS NOT NULL").select("id", "book_id", "idx")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("idx", "id")) - 1
    return rows.withColumn("n", n).select(F.concat("book_id", F.lit("/"), F.floor(F.col("n") / 5).cast("string")).alias("batch"), (F.col("n") % 5).alias("pos"), "id", "idx")


@query(f"""
SELECT batch, CASE WHEN r <= ceil(n / 2) THEN 0 ELSE 1 END AS part, pos, id FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n, row_number() OVER (PARTITION BY batch ORDER BY pos) AS r FROM {_BATCHES}) WHERE n > 1 AND batch LIKE '%/0'""")
def batches_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book's first batch failed and is tried again in halves"""
    rows = _batches(spark, sf_dir)
    return op.halved(rows, rows.where("batch LIKE '%/0'").select("batch").distinct()).select("batch", "part", "pos", "id")


@query(f"""
WITH b AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM {_BATCHES}) SELECT batch, id AS chapter_id, CASE WHEN n % 2 = 0 THEN concat('at ', CAST(n - 1 - pos AS VARCHAR)) ELSE concat('idx ', CAST(idx AS VARCHAR)) END AS result FROM b WHERE n % 2 = 0 OR pos <> 1""")
def results_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of an even number of chapters have all results, in an order of their own; the others lack their second"""
    rows = _batches(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("batch")))
    even = F.col("n") % 2 == 0
    said = F.when(even, F.concat(F.lit("at "), (F.col("n") - 1 - F.col("pos")).cast("string"))).otherwise(F.concat(F.lit("idx "), F.col("idx").cast("string")))
    results = rows.where(even | (F.col("pos") != 1)).select("batch", F.col("pos").alias("place"), F.when(~even, F.col("idx")).alias("chapter_idx"), said.alias("result"))
    return op.aligned(results, rows.select("batch", F.col("pos").alias("place"), "idx", F.col("id").alias("chapter_id")))
