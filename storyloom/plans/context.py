"""Queries of operators/context.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions.text import chapter_label, chapters_asked_for
from storyloom.operators import context as op
from storyloom.operators import passages, vectors
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()


@query("SELECT e.id, e.canonical_name AS name, e.type, count(m.id) AS weight FROM {kb_entities} e LEFT JOIN {kb_mentions} m ON m.entity_id = e.id GROUP BY ALL ORDER BY weight DESC, id LIMIT 40")
def entity_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J20, O1"""
    return op.entity_cloud(view(spark, sf_dir, "kb_entities"), view(spark, sf_dir, "kb_mentions"), 40)


@query("SELECT book_id, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM {kb_chapters} GROUP BY book_id")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2"""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return view(spark, sf_dir, "kb_chapters").groupBy("book_id").agg(count("done"), count("pending"), count("failed"), F.count("*").alias("total"))


@query("""
SELECT book_id, concat('chapters.', coalesce(status, 'none')) AS measure, count(*) AS n FROM {kb_chapters} GROUP BY ALL
UNION ALL SELECT book_id, 'events.all', count(*) FROM {kb_happenings} GROUP BY ALL
UNION ALL SELECT book_id, 'rules.all', count(*) FROM {kb_rules} GROUP BY ALL
UNION ALL SELECT book_id, concat('foreshadowing.', status), count(*) FROM {kb_foreshadowing} GROUP BY ALL
UNION ALL SELECT e.book_id, 'mentions.all', count(*) FROM {kb_mentions} m JOIN {kb_entities} e ON e.id = m.entity_id GROUP BY ALL
UNION ALL SELECT book_id, 'chunks.all', CAST(sum(n) AS BIGINT) FROM (SELECT book_id, count(*) AS n FROM {kb_chapters} WHERE status = 'done' AND coalesce(summary, '') <> '' GROUP BY ALL UNION ALL SELECT e.book_id, sum((m.n + 199) // 200) FROM {kb_entities} e JOIN (SELECT entity_id, count(*) AS n FROM {kb_mentions} GROUP BY ALL) m ON m.entity_id = e.id GROUP BY ALL
  UNION ALL SELECT book_id, count(*) FROM {kb_happenings} GROUP BY ALL UNION ALL SELECT book_id, count(*) FROM {kb_foreshadowing} GROUP BY ALL UNION ALL SELECT book_id, count(*) FROM {kb_rules} GROUP BY ALL) GROUP BY ALL""")
def kb_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4, J19, V10"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    mentions = v("kb_mentions").join(v("kb_entities").select(F.col("id").alias("entity_id"), "book_id"), "entity_id")
    every = F.lit("all")
    return op.overview({"chapters": (v("kb_chapters"), F.col("status")), "events": (v("kb_happenings"), every), "rules": (v("kb_rules"), every), "foreshadowing": (v("kb_foreshadowing"), F.col("status")), "mentions": (mentions, every), "chunks": (vectors.chunk_texts({"chapters": v("kb_chapters"), "entities": v("kb_entities"), "mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing"), "rules": v("kb_rules")}), every)})


@query("""
SELECT book_id, 'note' AS part, CAST(n AS INT) AS pos, id, title FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx DESC NULLS LAST, id DESC) AS n FROM {kb_chapters} WHERE status = 'done' AND coalesce(summary, '') <> '') WHERE n <= 5
UNION ALL SELECT book_id, 'current', 1, id, title FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY id) AS n FROM {kb_chapters} WHERE idx = 3) WHERE n = 1""")
def latest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the five latest notes of every book and its current chapter, here the one of index 3"""
    notes = op.first(view(spark, sf_dir, "kb_chapters", "status = 'done' AND coalesce(summary, '') <> ''"), "book_id", [F.desc("idx"), F.desc("id")], 5).select("book_id", F.lit("note").alias("part"), "pos", "id", "title")
    return notes.union(op.first(view(spark, sf_dir, "kb_chapters", "idx = 3"), "book_id", [F.col("id")], 1).select("book_id", F.lit("current"), "pos", "id", "title"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS message_id, unnest(list_slice(list_transform(regexp_extract_all(text, '第\s*(\d+)\s*章', 1), lambda n: CAST(n AS INT) - 1), 1, 3)) AS idx FROM documents WHERE text IS NOT NULL")
def requested_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chapters a message asks for"""
    asked = F.slice(chapters_asked_for(F.col("text")), 1, 3)
    return view(spark, sf_dir, "documents", "text IS NOT NULL").select(F.col("doc_id").cast("string").alias("message_id"), F.explode(asked).alias("idx"))


@query("SELECT e.id, e.mention_cnt AS stored, count(m.id) AS counted FROM {kb_entities} e LEFT JOIN {kb_mentions} m ON m.entity_id = e.id GROUP BY ALL HAVING count(m.id) <> coalesce(e.mention_cnt, -1)")
def stale_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters are derived, the stored ones only compared"""
    counts = view(spark, sf_dir, "kb_mentions").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("counted"))
    rows = view(spark, sf_dir, "kb_entities").join(counts, "id", "left").select("id", F.col("mention_cnt").alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return rows.where(F.col("counted") != F.coalesce("stored", F.lit(-1)))


SIZE_SQL = """
SELECT book_id, CAST(sum(n) AS BIGINT) AS characters FROM (
  SELECT book_id, length(coalesce(title, '')) + length(summary) AS n FROM {kb_chapters} WHERE status = 'done' AND coalesce(summary, '') <> ''
  UNION ALL SELECT e.book_id, length(coalesce(m.fact, '')) + length(coalesce(m.snippet, '')) FROM {kb_mentions} m JOIN {kb_entities} e ON e.id = m.entity_id
  UNION ALL SELECT book_id, length(coalesce(what, '')) + length(coalesce(who, '')) FROM {kb_happenings}
  UNION ALL SELECT book_id, length(coalesce(hint, '')) FROM {kb_foreshadowing} UNION ALL SELECT book_id, length(body) FROM {kb_rules}) GROUP BY book_id"""


@query(SIZE_SQL)
def kb_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table is summed before the results meet"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    size = lambda *c: F.sum(sum((F.length(F.coalesce(x, F.lit(""))) for x in c), F.lit(0))).alias("n")
    by_entity = v("kb_mentions").groupBy("entity_id").agg(size("fact", "snippet"))
    parts = [
        v("kb_chapters", "status = 'done' AND coalesce(summary, '') <> ''").groupBy("book_id").agg(size("title", "summary")),
        by_entity.join(v("kb_entities").select(F.col("id").alias("entity_id"), "book_id"), "entity_id").groupBy("book_id").agg(F.sum("n").alias("n")),
        v("kb_happenings").groupBy("book_id").agg(size("what", "who")), v("kb_foreshadowing").groupBy("book_id").agg(size("hint")), v("kb_rules").groupBy("book_id").agg(size("body")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("book_id").agg(F.sum("n").alias("characters"))


@query("SELECT chapter_id, entity_id, list(fact ORDER BY created_at, id) AS facts FROM {kb_mentions} WHERE fact IS NOT NULL AND chapter_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL")
def facts_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8"""
    return op.facts_by_entity(view(spark, sf_dir, "kb_mentions"))


@query("SELECT book_id, count(*) AS chapters, CAST(sum(length(content)) AS BIGINT) AS words FROM {kb_texts} GROUP BY book_id")
def book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    return view(spark, sf_dir, "kb_texts").groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum(F.length("content")).alias("words"))


_BLOCKS = "(SELECT id, book_id, idx, length(concat('## 第 ', CAST(idx + 1 AS VARCHAR), ' 章: ', coalesce(title, ''), chr(10), summary)) AS size FROM {kb_chapters} WHERE status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("## "), chapter_label(F.col("idx")), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n"), "summary")
    return view(spark, sf_dir, "kb_chapters", "status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL").select("id", "book_id", "idx", F.length(block).alias("size"))


@query(f"SELECT id, used FROM (SELECT id, CAST(sum(size) OVER (PARTITION BY book_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM {_BLOCKS}) WHERE used <= 1200")
def blocks_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, C9"""
    return op.packed_blocks(_blocks(spark, sf_dir), "book_id", [F.col("idx"), F.col("id")], 1200).select("id", "used")


@query(f"""
SELECT id, least(upto, 900) - least(upto - least(size, 60), 900) AS kept FROM (SELECT id, size, CAST(sum(least(size, 60)) OVER (PARTITION BY book_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM {_BLOCKS})
WHERE least(upto, 900) > least(upto - least(size, 60), 900)""")
def blocks_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5"""
    return op.cut_blocks(_blocks(spark, sf_dir), "book_id", [F.col("idx"), F.col("id")], 900, 60).select("id", "kept")


@query("""
WITH RECURSIVE o AS (SELECT book_id, chapter_id AS id, length(coalesce(title, '')) + length(coalesce(content, '')) + 240 AS cost, coalesce(trim(content), '') = '' AS alone,
  row_number() OVER (PARTITION BY book_id ORDER BY idx, chapter_id) AS pos FROM {kb_texts} WHERE book_id IS NOT NULL AND idx IS NOT NULL),
r AS (SELECT book_id, id, pos, 1 AS batch, cost AS used, 1 AS n, alone AS shut FROM o WHERE pos = 1
  UNION ALL SELECT o.book_id, o.id, o.pos, CASE WHEN r.shut OR o.alone OR r.n >= 4 OR r.used + o.cost > 6000 THEN r.batch + 1 ELSE r.batch END,
    CASE WHEN r.shut OR o.alone OR r.n >= 4 OR r.used + o.cost > 6000 THEN o.cost ELSE r.used + o.cost END, CASE WHEN r.shut OR o.alone OR r.n >= 4 OR r.used + o.cost > 6000 THEN 1 ELSE r.n + 1 END, o.alone
  FROM r JOIN o ON o.book_id = r.book_id AND o.pos = r.pos + 1)
SELECT id, batch FROM r""".replace("WITH RECURSIVE", "WITH"))
def chapter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11, W12"""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    alone = F.coalesce(F.trim("content"), F.lit("")) == ""
    rows = view(spark, sf_dir, "kb_texts", "book_id IS NOT NULL AND idx IS NOT NULL").select("book_id", "idx", F.col("chapter_id").alias("id"), (n("title") + n("content") + 240).alias("cost"), alone.alias("alone"))
    return op.batches(rows, "book_id", ["idx", "id"], 4, 6000)


@query("SELECT id, book_id, idx FROM (SELECT id, book_id, idx, row_number() OVER (PARTITION BY book_id ORDER BY idx DESC, id DESC) AS n FROM {kb_chapters} WHERE coalesce(summary, '') <> '' AND book_id IS NOT NULL AND idx IS NOT NULL) WHERE n <= 8")
def recent_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, C8, C14"""
    rows = view(spark, sf_dir, "kb_chapters", "coalesce(summary, '') <> '' AND book_id IS NOT NULL AND idx IS NOT NULL")
    return op.latest(rows, "book_id", [F.desc("idx"), F.desc("id")], 8).select("id", "book_id", "idx")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12")
def messages_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve of a conversation, each user being one"""
    return op.latest(view(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 12).select("event_id", "user_id")


@query("""
SELECT h.id, concat('- **', CASE WHEN c.idx IS NULL THEN '?' ELSE concat('第 ', CAST(c.idx + 1 AS VARCHAR), ' 章') END, '** (', coalesce(h.story_time, ''), '): ', coalesce(h.who, ''), ' — ', coalesce(h.what, ''),
  CASE WHEN coalesce(h.where_loc, '') = '' THEN '' ELSE concat('（', h.where_loc, '）') END) AS line FROM {kb_happenings} h LEFT JOIN {kb_chapters} c ON c.id = h.chapter_id""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9"""
    chapters = view(spark, sf_dir, "kb_chapters").select(F.col("id").alias("chapter_id"), "idx")
    return view(spark, sf_dir, "kb_happenings").join(chapters, "chapter_id", "left").select("id", op.event_line(F.col("idx")).alias("line"))


@query("""
WITH cand AS (SELECT c.id, c.book_id, CASE WHEN f.id IS NOT NULL THEN 0 ELSE 1 END AS prio, c.idx FROM {kb_chapters} c LEFT JOIN (SELECT DISTINCT hint_chapter_id AS id FROM {kb_foreshadowing} WHERE status = 'open') f ON f.id = c.id
  WHERE c.book_id IS NOT NULL AND coalesce(c.summary, '') <> '')
SELECT id, prio FROM (SELECT id, prio, row_number() OVER (PARTITION BY book_id ORDER BY prio, idx, id) AS n FROM cand) WHERE n <= 12""")
def chapters_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (chapters with an open hint) first, each book's twelve"""
    hinted = view(spark, sf_dir, "kb_foreshadowing", "status = 'open'").select(F.col("hint_chapter_id").alias("id"), F.lit(0).alias("prio")).distinct()
    rows = view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL AND coalesce(summary, '') <> ''").join(hinted, "id", "left").withColumn("prio", F.coalesce("prio", F.lit(1)))
    return op.latest(rows, "book_id", [F.col("prio"), F.col("idx"), F.col("id")], 12).select("id", "prio")


@query()
def focus_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every chapter the passages around the snippets of its facts. The lists hold one chapter's different snippets."""
    snippets = view(spark, sf_dir, "kb_mentions", "chapter_id IS NOT NULL AND trim(snippet) <> ''").groupBy("chapter_id").agg(F.array_sort(F.collect_set("snippet")).alias("wanted"))
    texts = view(spark, sf_dir, "kb_texts").join(snippets, "chapter_id", "left")
    return texts.select("chapter_id", passages.passages(F.col("content"), F.col("wanted"), 6000).alias("passages"))
