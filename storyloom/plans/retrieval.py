"""Queries of operators/retrieval.py: outlines, blocks and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import budget as budgets
from storyloom.functions.text import STRIPPED_SQL, asks_for_hints, asks_for_timeline, chapters_asked_for, initial_sql, stripped
from storyloom.operators import lookups
from storyloom.operators import retrieval as op
from storyloom.operators import vectors as vec
from storyloom.operators.timeline import with_defaults
from storyloom.plans import lookups as lookup_plans
from storyloom.plans.base import registry
from storyloom.plans.context import SIZE_SQL, kb_size
from storyloom.plans.timeline import _LAID, _ordered
from storyloom.session import written
from storyloom.sources.views import view

QUERIES, SQL, query = registry()
_S = STRIPPED_SQL.format
_LABEL = "CASE WHEN {0} IS NULL THEN '?' ELSE concat('第 ', CAST({0} + 1 AS VARCHAR), ' 章') END"


def _chapters(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return view(spark, sf_dir, "kb_chapters").select(F.col("id").alias("chapter_id"), *columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "kb_happenings").join(_chapters(spark, sf_dir, "book_id", "idx"), ["chapter_id", "book_id"], "left")


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _chapters(spark, sf_dir, "idx").withColumnRenamed("chapter_id", "hint_chapter_id")
    return view(spark, sf_dir, "kb_foreshadowing").join(at, "hint_chapter_id", "left")


# ---- blocks

_FACTS = f"""(SELECT m.entity_id, concat('### ', {_LABEL.format('c.idx')}, ': ', coalesce(c.title, ''), chr(10), '- ', coalesce(m.fact, ''), CASE WHEN coalesce(m.snippet, '') <> '' THEN concat(chr(10), '  > ', m.snippet) ELSE '' END, chr(10)) AS line,
  row_number() OVER (PARTITION BY m.entity_id ORDER BY c.idx NULLS FIRST, m.id) AS n FROM {{kb_mentions}} m LEFT JOIN {{kb_chapters}} c ON c.id = m.chapter_id)"""
_HEAD = "concat('## ', coalesce(canonical_name, ''), ' (', coalesce(type, ''), ')', CASE WHEN coalesce(array_to_string(list_filter(aliases, lambda x: x IS NOT NULL), '、'), '') <> '' THEN concat(chr(10), '别名：', array_to_string(list_filter(aliases, lambda x: x IS NOT NULL), '、')) ELSE '' END, chr(10))"


def _blocks_sql(most: int) -> str:
    return f"""(SELECT e.id, e.book_id, e.canonical_name, concat_ws(chr(10), e.head, f.lines) AS text FROM (SELECT id, book_id, canonical_name, {_HEAD} AS head FROM {{kb_entities}}) e
  LEFT JOIN (SELECT entity_id, string_agg(line, chr(10) ORDER BY n) AS lines FROM (SELECT x.entity_id, x.line, x.n, sum(length(x.line) + 1) OVER (PARTITION BY x.entity_id ORDER BY x.n) + length(h.head) AS upto FROM {_FACTS} x JOIN (SELECT id, {_HEAD} AS head FROM {{kb_entities}}) h ON h.id = x.entity_id) WHERE upto <= {most} GROUP BY ALL) f
  ON f.entity_id = e.id WHERE length(e.head) <= {most})"""


def _blocks(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    v = lambda n: view(spark, sf_dir, n)
    return op.entity_blocks(v("kb_entities"), v("kb_mentions"), v("kb_chapters"), most)


@query(f"SELECT id, canonical_name, text FROM {_blocks_sql(3000)}")
def entity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with as many of its facts as fit 3,000 characters"""
    return _blocks(spark, sf_dir, 3000).select("id", "canonical_name", "text")


@query(f"""
SELECT concat('c', c.id) AS id, CASE WHEN length(t) > 120 THEN concat(substr(t, 1, 117), '...') ELSE t END AS line FROM (SELECT id, concat('## ', CASE WHEN idx IS NULL THEN '章节' ELSE {_LABEL.format('idx')} END, ': ', coalesce(title, ''), chr(10), coalesce(summary, '')) AS t FROM {{kb_chapters}}) c
UNION ALL SELECT concat('e', h.id), concat('- **', {_LABEL.format('c.idx')}, '** (', coalesce(story_time, ''), '): ', coalesce(who, ''), ' — ', coalesce(what, ''), CASE WHEN coalesce(where_loc, '') = '' THEN '' ELSE concat('（', where_loc, '）') END) FROM {{kb_happenings}} h LEFT JOIN {{kb_chapters}} c ON c.id = h.chapter_id AND c.book_id = h.book_id
UNION ALL SELECT concat('f', f.id), concat('- ', coalesce(f.hint, ''), '（', {_LABEL.format('c.idx')}, '）') FROM {{kb_foreshadowing}} f LEFT JOIN {{kb_chapters}} c ON c.id = f.hint_chapter_id""")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut to 120 characters, events and hints as they are shown"""
    chapters = view(spark, sf_dir, "kb_chapters").select(F.concat(F.lit("c"), "id").alias("id"), op.chapter_block(120).alias("line"))
    events = _events(spark, sf_dir).select(F.concat(F.lit("e"), "id"), op.event_line())
    return chapters.union(events).union(_hints(spark, sf_dir).select(F.concat(F.lit("f"), "id"), op.hint_line()))


_BLOCK = f"concat('## ', CASE WHEN idx IS NULL THEN '章节' ELSE {_LABEL.format('idx')} END, ': ', coalesce(title, ''), chr(10), coalesce(summary, ''))"


@query(f"""
WITH recent AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx DESC NULLS LAST, id DESC) AS n FROM (SELECT book_id, id, idx, {_BLOCK} AS text FROM {{kb_chapters}} WHERE status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL)),
fit AS (SELECT * FROM (SELECT book_id, n, text, 9 + sum(length(text)) OVER (PARTITION BY book_id ORDER BY n DESC) AS upto FROM recent WHERE n <= 8) WHERE upto <= 700),
used AS (SELECT b.book_id, coalesce(max(f.upto), 9) AS used FROM (SELECT DISTINCT book_id FROM recent) b LEFT JOIN fit f ON f.book_id = b.book_id GROUP BY ALL),
items AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY canonical_name NULLS FIRST, id) AS n FROM (SELECT book_id, id, canonical_name, concat('- ', coalesce(canonical_name, ''), '（', coalesce(type, ''), '）') AS text FROM {{kb_entities}} WHERE book_id IS NOT NULL)),
room AS (SELECT * FROM (SELECT i.book_id, i.n, i.text, u.used + 8 + sum(length(i.text)) OVER (PARTITION BY i.book_id ORDER BY i.n) AS upto FROM items i JOIN used u ON u.book_id = i.book_id AND u.used < 700 WHERE i.n <= 40) WHERE upto <= 700),
lines AS (SELECT book_id, 0 AS p, 0 AS n, concat('# 已入库前情索引', chr(10)) AS text FROM used UNION ALL SELECT book_id, 1, -n, concat(text, chr(10)) FROM fit UNION ALL SELECT DISTINCT i.book_id, 2, 0, '## 已识别实体' FROM items i JOIN used u ON u.book_id = i.book_id AND u.used < 700 UNION ALL SELECT book_id, 3, n, text FROM room)
SELECT book_id, substr(string_agg(text, chr(10) ORDER BY p, n), 1, 700) AS text FROM lines GROUP BY book_id""")
def contexts_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came before, within 700 characters"""
    return op.context_before(view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL"), view(spark, sf_dir, "kb_entities", "book_id IS NOT NULL"), 700)


@query("""
SELECT book_id, 'note' AS part, CAST(row_number() OVER (PARTITION BY book_id ORDER BY idx NULLS FIRST, id) AS INT) AS pos, concat('第 ', CAST(coalesce(idx, 0) + 1 AS VARCHAR), ' 章《', coalesce(title, ''), '》：', substr(summary, 1, 800)) AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx DESC NULLS LAST, id DESC) AS n FROM {kb_chapters} WHERE status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL) WHERE n <= 6
UNION ALL SELECT book_id, 'hint', CAST(n AS INT), concat('- 第 ', CAST(coalesce(idx, 0) + 1 AS VARCHAR), ' 章：', coalesce(hint, '')) FROM (SELECT f.*, c.idx, row_number() OVER (PARTITION BY f.book_id ORDER BY c.idx NULLS FIRST, f.id) AS n FROM {kb_foreshadowing} f LEFT JOIN {kb_chapters} c ON c.id = f.hint_chapter_id WHERE f.status = 'open' AND f.book_id IS NOT NULL) WHERE n <= 20""")
def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six notes and twenty open hints of every book"""
    return op.prediction_lines(view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL"), _hints(spark, sf_dir).where("book_id IS NOT NULL"))


# ---- outlines

_BEFORE = lookup_plans._ranked_pairs("(f.idx, f.chapter_id) < (b.idx, b.chapter_id)", "f.idx DESC, f.chapter_id DESC, f.id DESC", 3)


@query(f"""
WITH heads AS (SELECT DISTINCT m.chapter_id, e.id, {initial_sql('e.canonical_name')} AS ini, coalesce(e.canonical_name, '') AS name, coalesce(e.type, '') AS type FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id CROSS JOIN {{initials}} ini WHERE m.chapter_id IS NOT NULL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY ini, name, id) AS INT) AS pos FROM heads)
SELECT chapter_id, 'entity' AS part, pos, id, concat_ws(' | ', ini, name, type) AS line FROM placed
UNION ALL SELECT p.chapter_id, 'fact', p.pos, m.id, concat_ws(' | ', coalesce(m.fact, ''), coalesce(m.snippet, '')) FROM placed p JOIN {{kb_mentions}} m ON m.chapter_id = p.chapter_id AND m.entity_id = p.id
UNION ALL SELECT p.chapter_id, 'before', p.pos, m.id, concat_ws(' | ', {_LABEL.format('c.idx')}, coalesce(c.title, ''), coalesce(m.fact, ''), coalesce(m.snippet, '')) FROM placed p JOIN ({_BEFORE}) b ON b.chapter_id = p.chapter_id AND b.entity_id = p.id JOIN {{kb_mentions}} m ON m.id = b.mention_id JOIN {{kb_chapters}} c ON c.id = m.chapter_id
UNION ALL SELECT chapter_id, 'rule', CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY ini, name, rule_id, evidence) AS INT), rule_id, concat_ws(' | ', ini, name, body, evidence, {_LABEL.format('first_idx')}) FROM (
  SELECT r.*, {initial_sql('r.name')} AS ini FROM (SELECT m.chapter_id, r.id AS rule_id, coalesce(r.name, '') AS name, coalesce(r.body, '') AS body, coalesce(m.evidence, '') AS evidence, c.idx AS first_idx FROM {{kb_rule_mentions}} m JOIN {{kb_rules}} r ON r.id = m.rule_id LEFT JOIN {{kb_chapters}} c ON c.id = r.first_chapter_id WHERE m.chapter_id IS NOT NULL
    UNION SELECT r.first_chapter_id, r.id, coalesce(r.name, ''), coalesce(r.body, ''), '', c.idx FROM {{kb_rules}} r LEFT JOIN {{kb_chapters}} c ON c.id = r.first_chapter_id WHERE r.first_chapter_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{kb_rule_mentions}} m WHERE m.rule_id = r.id AND m.chapter_id = r.first_chapter_id)) r CROSS JOIN {{initials}} ini)
UNION ALL SELECT chapter_id, 'event', CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY story_order, id) AS INT), id, line FROM (SELECT l.chapter_id, l.story_order, l.id, concat_ws(' | ', coalesce(h.story_time, ''), coalesce(h.who, ''), coalesce(h.what, '')) AS line FROM {_LAID} l JOIN {{kb_happenings}} h ON h.id = l.id WHERE l.chapter_id IS NOT NULL)
UNION ALL SELECT c, 'foreshadowing', CAST(row_number() OVER (PARTITION BY c ORDER BY id) AS INT), id, concat_ws(' | ', status, coalesce(hint, ''), coalesce(resolution, '')) FROM (SELECT hint_chapter_id AS c, * FROM {{kb_foreshadowing}} WHERE hint_chapter_id IS NOT NULL UNION SELECT resolved_chapter_id, * FROM {{kb_foreshadowing}} WHERE resolved_chapter_id IS NOT NULL)
UNION ALL SELECT chapter_id, 'alert', CAST(n AS INT), id, concat_ws(' | ', kind, severity, message) FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY created_at DESC, id) AS n FROM {{kb_alerts}} WHERE status = 'open' AND chapter_id IS NOT NULL) WHERE n <= 8""")
def chapter_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every chapter the entities by initial and name with their facts and three earlier ones, rules, events, hints and the latest eight open alerts"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    facts = lookup_plans._facts(spark, sf_dir)
    return op.outlines(v("kb_entities"), v("kb_mentions", "chapter_id IS NOT NULL"), v("kb_chapters"), lookups.recent_before(facts, 3), lookup_plans.chapter_rules(spark, sf_dir), with_defaults(_ordered(spark, sf_dir)).join(v("kb_happenings").select("id", "story_time", "who", "what"), "id"), v("kb_foreshadowing"), v("kb_alerts", "status = 'open' AND chapter_id IS NOT NULL"))


# ---- questions: every document that belongs to a book is one

_CTX = 12_000
_ASKED = f"""(SELECT CAST(d.doc_id AS VARCHAR) AS question_id, d.book_id, d.text, least(greatest(4000, {_CTX} - (1500 + CAST(floor(length(d.text) * 0.55::DOUBLE) AS INT) + 500 + 2000 + {_CTX} // 20)), coalesce(z.characters, 0) + 1000) AS budget,
  regexp_matches(d.text, '第\\s*\\d+\\s*章|什么时候|时间线|顺序|经过') AS timeline, regexp_matches(d.text, '伏笔|悬念|线索|未解|铺垫') AS hints FROM documents d LEFT JOIN ({SIZE_SQL}) z ON z.book_id = d.book_id WHERE d.book_id IS NOT NULL AND coalesce(d.text, '') <> '')"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents", "book_id IS NOT NULL AND coalesce(text, '') <> ''").select(F.col("doc_id").cast("string").alias("question_id"), "book_id", "text")
    left = budgets.context_budget(F.lit(_CTX), budgets.tokens(F.length("text")), F.lit(0))["budget"]
    rows = rows.join(kb_size(spark, sf_dir), "book_id", "left")
    return rows.select("question_id", "book_id", "text", F.least(left, F.coalesce("characters", F.lit(0)) + 1000).alias("budget"), asks_for_timeline(F.col("text")).alias("timeline"), asks_for_hints(F.col("text")).alias("hints"))


def _named(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """(text_id, entity_id, canonical_name) of texts (book_id, text_id, text) and the entities of their book they name."""
    entities = view(spark, sf_dir, "kb_entities").select("book_id", F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    names = entities.union(view(spark, sf_dir, "kb_aliases").select("book_id", "entity_id", "alias_raw")).distinct()
    return lookups.names_in_texts(names, texts).join(entities.select("entity_id", F.col("name").alias("canonical_name")), "entity_id")


def _asked(spark: SparkSession, sf_dir: str, hits) -> DataFrame:
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    questions = written(_questions(spark, sf_dir), "questions")
    named = written(_named(spark, sf_dir, questions.select("book_id", F.col("question_id").alias("text_id"), "text")).withColumnRenamed("text_id", "question_id"), "named")
    chapters = v("kb_chapters", "book_id IS NOT NULL")
    asked = questions.select("question_id", "book_id", F.explode(chapters_asked_for(F.col("text"))).alias("idx")).distinct()
    stated = asked.join(chapters.groupBy("book_id", "idx").agg(F.min("id").alias("ref_id")), ["book_id", "idx"]).select("question_id", F.lit("chapter").alias("kind"), "ref_id")
    who = v("kb_happenings", "who IS NOT NULL AND book_id IS NOT NULL").select("book_id", F.col("id").alias("text_id"), F.col("who").alias("text"))
    names = v("kb_entities").select("book_id", F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    inside = lookups.names_in_texts(names, who).join(names.withColumnRenamed("name", "canonical_name"), "entity_id").select("book_id", "canonical_name", F.col("text_id").alias("id")).distinct()
    kb = {"chapters": v("kb_chapters"), "blocks": _blocks(spark, sf_dir, 3000), "events": _events(spark, sf_dir).where("book_id IS NOT NULL"), "hints": _hints(spark, sf_dir).where("book_id IS NOT NULL"), "names_in_events": inside}
    found = stated if hits is None else stated.union(hits(questions))
    return op.question_contexts(kb, questions, named, found, F.lit(3000), F.lit(1800))


@query(f"""
WITH q AS MATERIALIZED (SELECT * FROM {_ASKED}),
named AS MATERIALIZED (SELECT DISTINCT q.question_id, n.id, e.canonical_name FROM q JOIN (SELECT book_id, id, canonical_name AS name FROM {{kb_entities}} UNION SELECT book_id, entity_id, alias_raw FROM {{kb_aliases}}) n ON n.book_id = q.book_id AND trim(n.name, ' ') <> '' AND contains(lower(q.text), lower(n.name)) JOIN {{kb_entities}} e ON e.id = n.id),
ev AS MATERIALIZED (SELECT h.book_id, h.id, h.who, concat('- **', {_LABEL.format('c.idx')}, '** (', coalesce(story_time, ''), '): ', coalesce(who, ''), ' — ', coalesce(what, ''), CASE WHEN coalesce(where_loc, '') = '' THEN '' ELSE concat('（', where_loc, '）') END) AS line,
  row_number() OVER (PARTITION BY h.book_id ORDER BY c.idx NULLS FIRST, h.created_at NULLS FIRST, h.id) AS place FROM {{kb_happenings}} h LEFT JOIN {{kb_chapters}} c ON c.id = h.chapter_id AND c.book_id = h.book_id WHERE h.book_id IS NOT NULL),
told AS (SELECT q.question_id, e.line, row_number() OVER (PARTITION BY q.question_id ORDER BY e.place) AS n FROM q JOIN ev e ON e.book_id = q.book_id WHERE q.timeline AND (NOT EXISTS (SELECT 1 FROM named x WHERE x.question_id = q.question_id)
  OR EXISTS (SELECT 1 FROM named x WHERE x.question_id = q.question_id AND trim(x.canonical_name, ' ') <> '' AND contains(lower(e.who), lower(x.canonical_name))))),
tl AS (SELECT q.question_id, 0 AS part, CASE WHEN count(t.line) = 0 THEN concat('## 时间线', chr(10), '（暂无事件记录）') ELSE concat('## 时间线', chr(10), string_agg(t.line, chr(10) ORDER BY t.n)) END AS text FROM q LEFT JOIN told t ON t.question_id = q.question_id AND t.n <= 50 WHERE q.timeline GROUP BY ALL),
hs AS (SELECT book_id, line, n, sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY n) AS upto FROM (SELECT f.book_id, concat('- ', coalesce(f.hint, ''), '（', {_LABEL.format('c.idx')}, '）') AS line, row_number() OVER (PARTITION BY f.book_id ORDER BY c.idx NULLS FIRST, f.id) AS n FROM {{kb_foreshadowing}} f LEFT JOIN {{kb_chapters}} c ON c.id = f.hint_chapter_id WHERE f.status = 'open' AND f.book_id IS NOT NULL)),
hn AS (SELECT q.question_id, 1 AS part, CASE WHEN count(h.line) = 0 THEN concat('## 伏笔（open）', chr(10), '（暂无记录）') ELSE concat('## 未解伏笔', chr(10), string_agg(h.line, chr(10) ORDER BY h.n)) END AS text FROM q LEFT JOIN hs h ON h.book_id = q.book_id AND h.upto <= q.budget WHERE q.hints GROUP BY ALL),
head AS MATERIALIZED (SELECT * FROM tl UNION ALL SELECT * FROM hn),
rest AS MATERIALIZED (SELECT q.question_id, q.book_id, q.budget - coalesce(h.used, 0) AS "left" FROM q LEFT JOIN (SELECT question_id, sum(length(text)) AS used FROM head GROUP BY ALL) h ON h.question_id = q.question_id),
hits AS MATERIALIZED (SELECT DISTINCT q.question_id, 2 AS part, (SELECT min(c.id) FROM {{kb_chapters}} c WHERE c.book_id = q.book_id AND c.idx = q.i) AS id FROM (SELECT question_id, book_id, CAST(unnest(regexp_extract_all(text, '第\\s*(\\d+)\\s*章', 1)) AS BIGINT) - 1 AS i FROM q) q UNION SELECT question_id, 3, id FROM named),
blocks AS MATERIALIZED (SELECT book_id, id, 2 AS part, {_BLOCK} AS text, 1800 AS cap, '' AS name, coalesce(idx, -1) AS i FROM {{kb_chapters}} WHERE status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL UNION ALL SELECT book_id, id, 3, text, 3000, canonical_name, 0 FROM {_blocks_sql(3000)} WHERE book_id IS NOT NULL),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY book_id, part ORDER BY name NULLS FIRST, i, id) AS rank FROM blocks),
laid AS (SELECT r.question_id, r."left", b.part, b.id, b.text, least(length(b.text), b.cap) AS n, sum(least(length(b.text), b.cap)) OVER w AS upto, row_number() OVER w AS o FROM rest r JOIN ranked b ON b.book_id = r.book_id LEFT JOIN hits h ON h.question_id = r.question_id AND h.part = b.part AND h.id = b.id WHERE r."left" > 0
  WINDOW w AS (PARTITION BY r.question_id ORDER BY b.part, CASE WHEN h.id IS NULL THEN 1 ELSE 0 END, b.rank)),
shown AS (SELECT question_id, part, o, id, text, least(upto, "left") - least(upto - n, "left") AS kept FROM laid)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY part, o) AS INT) AS pos, kind, ref_id, text FROM (SELECT question_id, part, 0 AS o, CASE part WHEN 0 THEN 'timeline' ELSE 'hints' END AS kind, NULL AS ref_id, text FROM head
  UNION ALL SELECT question_id, part, o, CASE part WHEN 2 THEN 'chapter' ELSE 'entity' END, id, CASE WHEN length(text) > kept THEN concat(substr(text, 1, CAST(greatest(kept - 3, 0) AS INT)), substr('...', 1, CAST(least(kept, 3) AS INT))) ELSE text END FROM shown WHERE kept > 0)""")
def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts by names and chapters stated; every document is a question to its book"""
    return _asked(spark, sf_dir, None)


@query()
def question_contexts_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the 8 nearest chunks of all besides"""

    def hits(questions: DataFrame) -> DataFrame:
        from storyloom.plans.vectors import _kb

        chunks = written(vec.chunk_texts(_kb(spark, sf_dir)).where("source_type IN ('entity', 'chapter_summary')").withColumn("n", F.xxhash64("id")), "chunks")
        number = lambda rows: rows.select(F.col("id").cast("bigint").alias("id"), "vector")
        stored = number(vec.embedded(chunks.select(F.col("n").cast("string").alias("id"), "text")))
        near = vec.nearest(number(vec.embedded(questions.select(F.col("question_id").alias("id"), "text"))), stored, 8)
        found = near.join(chunks.select(F.col("n").alias("vec_id"), "book_id", "source_type", "source_id"), "vec_id").select(F.col("query_id").cast("string").alias("question_id"), "book_id", "source_type", "source_id")
        own = found.join(questions.select("question_id", "book_id"), ["question_id", "book_id"], "left_semi")
        return own.select("question_id", F.when(F.col("source_type") == "entity", "entity").otherwise("chapter").alias("kind"), F.col("source_id").alias("ref_id")).distinct()

    return _asked(spark, sf_dir, hits)


# ---- reading: each chapter is read with the events and facts of its own entities as hits

_HITS = """(SELECT chapter_id AS reader_id, concat('1', id) AS rank, 'event' AS source_type, id AS source_id, coalesce(what, '') AS document FROM {kb_happenings} WHERE chapter_id IS NOT NULL
  UNION ALL SELECT chapter_id, concat('0', id), 'entity', entity_id, coalesce(fact, '') FROM {kb_mentions} WHERE chapter_id IS NOT NULL AND entity_id IS NOT NULL)"""


@query(f"""
WITH recent AS (SELECT * FROM (SELECT book_id, concat('## 前情回顾', chr(10), CASE WHEN idx IS NULL THEN '章节' ELSE {_LABEL.format('idx')} END, ': ', coalesce(title, ''), chr(10), summary, chr(10)) AS text, row_number() OVER (PARTITION BY book_id ORDER BY idx DESC NULLS LAST, id DESC) AS n
  FROM {{kb_chapters}} WHERE status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL) WHERE n <= 3),
fit AS (SELECT * FROM (SELECT *, sum(length(text)) OVER (PARTITION BY book_id ORDER BY n DESC) AS upto FROM recent) WHERE upto <= 900),
anchor AS (SELECT book_id, string_agg(text, chr(10) ORDER BY n DESC) AS text, max(upto) AS used FROM fit GROUP BY ALL),
once AS (SELECT reader_id, source_type, source_id, min(rank) AS rank, arg_min(document, (rank, document)) AS document FROM {_HITS} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY rank, source_type, source_id) AS n FROM once),
found AS (SELECT reader_id, concat('## 检索相关', chr(10), string_agg(concat('- [', source_type, '] ', CASE WHEN length(document) > 300 THEN concat(substr(document, 1, 300), '…') ELSE document END), chr(10) ORDER BY n), chr(10)) AS block FROM ranked WHERE n <= 12 GROUP BY ALL)
SELECT c.id AS reader_id, substr(concat_ws(chr(10), a.text, CASE WHEN 900 - coalesce(a.used, 0) > 200 AND coalesce(a.used, 0) + length(f.block) <= 900 THEN f.block END), 1, 900) AS text FROM {{kb_chapters}} c LEFT JOIN anchor a ON a.book_id = c.book_id LEFT JOIN found f ON f.reader_id = c.id""")
def reading_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every chapter the last three notes of its book, then hits that fit, within 900 characters"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    events = v("kb_happenings", "chapter_id IS NOT NULL").select(F.col("chapter_id").alias("reader_id"), F.concat(F.lit("1"), "id").alias("rank"), F.lit("event").alias("source_type"), F.col("id").alias("source_id"), F.coalesce("what", F.lit("")).alias("document"))
    facts = v("kb_mentions", "chapter_id IS NOT NULL AND entity_id IS NOT NULL").select("chapter_id", F.concat(F.lit("0"), "id"), F.lit("entity"), "entity_id", F.coalesce("fact", F.lit("")))
    return op.reading_contexts(v("kb_chapters"), v("kb_chapters").select(F.col("id").alias("reader_id"), "book_id"), events.union(facts), 900)


# ---- consistency


def _focused_sql(focus: str, key: str, segments: int, each: int, most: int) -> str:
    return f"""(SELECT {key}, id, row_number() OVER (PARTITION BY {key} ORDER BY s, n) AS pos FROM (SELECT v.{key}, v.id, g.s, row_number() OVER (PARTITION BY v.{key}, v.segment_id ORDER BY v.story_order, v.idx NULLS FIRST, v.id) AS n FROM (
    SELECT f.{key}, l.* FROM {focus} f JOIN laid l ON l.book_id = f.book_id AND (l.importance >= 3 OR l.chapter_id = f.chapter_id)) v JOIN (
    SELECT {key}, segment_id, row_number() OVER (PARTITION BY {key} ORDER BY o, lane, segment_id) AS s FROM (SELECT f.{key}, l.segment_id, min(l.story_order) AS o, arg_min(l.lane, (l.story_order, coalesce(l.idx, -1), l.id)) AS lane FROM {focus} f JOIN laid l ON l.book_id = f.book_id AND (l.importance >= 3 OR l.chapter_id = f.chapter_id) GROUP BY ALL)) g
    ON g.{key} = v.{key} AND g.segment_id = v.segment_id WHERE g.s <= {segments}) WHERE n <= {each} QUALIFY pos <= {most})"""


_LINES = """ev AS MATERIALIZED (SELECT l.chapter_id, l.id, l.story_order, concat('- ', coalesce(h.story_time, ''), ' ', coalesce(h.who, ''), '：', coalesce(h.what, '')) AS line, row_number() OVER (PARTITION BY l.chapter_id ORDER BY l.story_order, l.id) AS n FROM laid l JOIN {kb_happenings} h ON h.id = l.id WHERE l.chapter_id IS NOT NULL),
rl AS MATERIALIZED (SELECT book_id, n, name, body FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY name NULLS FIRST, id) AS n FROM {kb_rules} WHERE book_id IS NOT NULL))"""
_TAIL = f"(SELECT chapter_id, book_id, right({_S('content')}, 2200) AS text FROM {{kb_texts}} WHERE length({_S('content')}) >= 80 AND chapter_id IS NOT NULL)"
_NAMES = "(SELECT book_id, id, canonical_name AS name FROM {kb_entities} UNION SELECT book_id, entity_id, alias_raw FROM {kb_aliases})"


def _event_lines(spark: SparkSession, sf_dir: str, laid: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(c, F.lit(""))
    told = view(spark, sf_dir, "kb_happenings").select("id", F.concat(F.lit("- "), s("story_time"), F.lit(" "), s("who"), F.lit("："), s("what")).alias("line"))
    return laid.where("chapter_id IS NOT NULL").join(told, "id").select("chapter_id", F.struct("story_order", "id").alias("o"), "line")


@query(f"""
WITH laid AS MATERIALIZED (SELECT * FROM {_LAID}), {_LINES}, t AS MATERIALIZED (SELECT * FROM {_TAIL}),
named AS (SELECT chapter_id, id, row_number() OVER (PARTITION BY chapter_id ORDER BY canonical_name NULLS FIRST, id) AS n, text FROM (SELECT DISTINCT t.chapter_id, b.id, b.canonical_name, b.text FROM t JOIN {_NAMES} n ON n.book_id = t.book_id AND trim(n.name, ' ') <> '' AND contains(lower(t.text), lower(n.name)) JOIN {_blocks_sql(1200)} b ON b.id = n.id)),
tl AS (SELECT z.chapter_id, z.pos, concat('- 顺序', CAST(l.story_order AS VARCHAR), ' 第', CAST(coalesce(l.idx, 0) + 1 AS VARCHAR), '章 ', coalesce(h.story_time, ''), ': ', coalesce(h.what, '')) AS line FROM {_focused_sql('t', 'chapter_id', 8, 8, 30)} z JOIN laid l ON l.id = z.id JOIN {{kb_happenings}} h ON h.id = z.id),
blocks AS (SELECT chapter_id, 0 AS part, n, text FROM named WHERE n <= 8
  UNION ALL SELECT t.chapter_id, 1, 0, concat('## 本章已入库事件', chr(10), string_agg(e.line, chr(10) ORDER BY e.n)) FROM t JOIN ev e ON e.chapter_id = t.chapter_id AND e.n <= 8 GROUP BY t.chapter_id
  UNION ALL SELECT t.chapter_id, 2, 0, concat('## 已确认/已记录规则', chr(10), string_agg(concat('- ', coalesce(r.name, ''), ': ', substr(coalesce(r.body, ''), 1, 180)), chr(10) ORDER BY r.n)) FROM t JOIN rl r ON r.book_id = t.book_id AND r.n <= 30 GROUP BY t.chapter_id
  UNION ALL SELECT chapter_id, 3, 0, concat('## 时间线参考', chr(10), string_agg(line, chr(10) ORDER BY pos)) FROM tl GROUP BY chapter_id)
SELECT t.chapter_id, t.text AS focus, coalesce(c.context, '') AS context FROM t LEFT JOIN (SELECT chapter_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY part, n), 1, 9000) AS context FROM blocks GROUP BY ALL) c ON c.chapter_id = t.chapter_id""")
def check_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every chapter long enough, and what a check of it is shown"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    body = stripped(F.col("content"))
    focus = written(v("kb_texts", "chapter_id IS NOT NULL").where(F.length(body) >= 80).select("chapter_id", "book_id", F.right(body, F.lit(2200)).alias("focus")), "focus")
    laid = written(with_defaults(_ordered(spark, sf_dir)), "laid")
    named = _named(spark, sf_dir, focus.select("book_id", F.col("chapter_id").alias("text_id"), F.col("focus").alias("text"))).select(F.col("text_id").alias("chapter_id"), "entity_id").distinct()
    told = v("kb_happenings").select("id", "story_time", "what").join(laid.select("id", "story_order", "idx"), "id")
    line = F.concat(F.lit("- 顺序"), F.col("story_order").cast("string"), F.lit(" 第"), (F.coalesce("idx", F.lit(0)) + 1).cast("string"), F.lit("章 "), F.coalesce("story_time", F.lit("")), F.lit(": "), F.coalesce("what", F.lit("")))
    timeline = op.focused_events(laid, focus.withColumn("k", F.col("chapter_id")), "k", 8, 8, 30).join(told.select("id", line.alias("line")), "id").select(F.col("k").alias("chapter_id"), "pos", "line")
    p = op.check_parts(focus.withColumn("k", F.col("chapter_id")), _blocks(spark, sf_dir, 1200), named.withColumnRenamed("chapter_id", "k"), _event_lines(spark, sf_dir, laid), op.rule_lines(v("kb_rules"), 30, 180), timeline.withColumnRenamed("chapter_id", "k"), "k", 8)
    context = op.check_contexts([(None, p["entities"]), (op.CHAPTER_EVENTS, p["events"]), (op.RULES, p["rules"]), (op.ORDER, p["timeline"])], "k", 9000).withColumnRenamed("k", "chapter_id")
    return focus.drop("book_id").join(context, "chapter_id", "left").select("chapter_id", "focus", F.coalesce("context", F.lit("")).alias("context"))


@query(f"""
WITH laid AS MATERIALIZED (SELECT * FROM {_LAID}), {_LINES}, a AS MATERIALIZED (SELECT al.*, c.book_id, c.idx FROM {{kb_alerts}} al JOIN {{kb_chapters}} c ON c.id = al.chapter_id WHERE c.book_id IS NOT NULL),
said AS (SELECT id AS alert_id, book_id, concat(coalesce(message, ''), ' ', coalesce(evidence, '')) AS text FROM a),
named AS (SELECT alert_id, text, row_number() OVER (PARTITION BY alert_id ORDER BY canonical_name NULLS FIRST, id) AS n FROM (SELECT DISTINCT s.alert_id, b.id, b.canonical_name, b.text FROM said s JOIN {_NAMES} n ON n.book_id = s.book_id AND trim(n.name, ' ') <> '' AND contains(lower(s.text), lower(n.name)) JOIN {_blocks_sql(1500)} b ON b.id = n.id)),
f AS MATERIALIZED (SELECT DISTINCT book_id, book_id AS k, CAST(NULL AS VARCHAR) AS chapter_id FROM a),
tl AS (SELECT z.k AS book_id, string_agg(concat('- 第', CAST(coalesce(l.idx, 0) + 1 AS VARCHAR), '章 ', coalesce(h.story_time, ''), ': ', coalesce(h.what, '')), chr(10) ORDER BY z.pos) AS lines FROM {_focused_sql('f', 'k', 6, 6, 25)} z JOIN laid l ON l.id = z.id JOIN {{kb_happenings}} h ON h.id = z.id GROUP BY ALL),
blocks AS (SELECT id AS alert_id, 0 AS part, 0 AS n, concat('## 雷达提醒', chr(10), '- 类型：', coalesce(kind, ''), chr(10), '- 严重度：', coalesce(severity, ''), chr(10), '- 提醒内容：', coalesce(message, ''), chr(10), '- 知识库依据：', coalesce(evidence, '')) AS text FROM a
  UNION ALL SELECT a.id, 1, 0, concat('## 当前章节（第', CAST(coalesce(a.idx, 0) + 1 AS VARCHAR), '章：', coalesce(t.title, ''), '）原文', chr(10), right(t.content, 6000)) FROM a JOIN {{kb_texts}} t ON t.chapter_id = a.chapter_id WHERE coalesce(t.content, '') <> ''
  UNION ALL SELECT alert_id, 2, n, text FROM named WHERE n <= 6
  UNION ALL SELECT a.id, 3, 0, concat('## 已确认规则', chr(10), string_agg(concat('- ', coalesce(r.name, ''), ': ', substr(coalesce(r.body, ''), 1, 200)), chr(10) ORDER BY r.n)) FROM a JOIN rl r ON r.book_id = a.book_id AND r.n <= 20 GROUP BY a.id
  UNION ALL SELECT a.id, 4, 0, concat('## 时间线参考', chr(10), tl.lines) FROM a JOIN tl ON tl.book_id = a.book_id
  UNION ALL SELECT a.id, 5, 0, concat('## 本章已入库事件', chr(10), string_agg(e.line, chr(10) ORDER BY e.n)) FROM a JOIN ev e ON e.chapter_id = a.chapter_id AND e.n <= 8 GROUP BY a.id)
SELECT alert_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY part, n), 1, 14000) AS context FROM blocks GROUP BY alert_id""")
def deep_check_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: of every alert what a second look at it is shown"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    s = lambda c: F.coalesce(c, F.lit(""))
    alerts = written(v("kb_alerts").join(_chapters(spark, sf_dir, "book_id", "idx").where("book_id IS NOT NULL"), "chapter_id").withColumnRenamed("id", "alert_id"), "alerts")
    laid = written(with_defaults(_ordered(spark, sf_dir)), "laid")
    named = _named(spark, sf_dir, alerts.select("book_id", F.col("alert_id").alias("text_id"), F.concat(s("message"), F.lit(" "), s("evidence")).alias("text"))).select(F.col("text_id").alias("alert_id"), "entity_id").distinct()
    told = v("kb_happenings").select("id", "story_time", "what").join(laid.select("id", "idx"), "id")
    line = F.concat(F.lit("- 第"), (F.coalesce("idx", F.lit(0)) + 1).cast("string"), F.lit("章 "), s("story_time"), F.lit(": "), s("what"))
    books = alerts.select("book_id").distinct().select("book_id", F.col("book_id").alias("k"), F.lit(None).cast("string").alias("chapter_id"))
    lines = op.focused_events(laid, books, "k", 6, 6, 25).join(told.select("id", line.alias("line")), "id")
    timeline = alerts.select("alert_id", F.col("book_id").alias("k")).join(lines, "k").select("alert_id", "pos", "line")
    head = F.concat(F.lit("## 雷达提醒\n- 类型："), s("kind"), F.lit("\n- 严重度："), s("severity"), F.lit("\n- 提醒内容："), s("message"), F.lit("\n- 知识库依据："), s("evidence"))
    texts = v("kb_texts", "coalesce(content, '') <> ''").select("chapter_id", "title", F.right("content", F.lit(6000)).alias("content"))
    body = F.concat(F.lit("## 当前章节（第"), (F.coalesce("idx", F.lit(0)) + 1).cast("string"), F.lit("章："), s("title"), F.lit("）原文\n"), "content")
    p = op.check_parts(alerts, _blocks(spark, sf_dir, 1500), named, _event_lines(spark, sf_dir, laid), op.rule_lines(v("kb_rules"), 20, 200), timeline, "alert_id", 6)
    zero = F.lit(0).alias("pos")
    parts = [(None, alerts.select("alert_id", zero, head.alias("text"))), (None, alerts.join(texts, "chapter_id").select("alert_id", zero, body.alias("text"))), (None, p["entities"]), (op.SURE_RULES, p["rules"]), (op.ORDER, p["timeline"]), (op.CHAPTER_EVENTS, p["events"])]
    return op.check_contexts(parts, "alert_id", 14_000)


@query("""
SELECT id AS key, CAST(n AS INT) AS n, CASE n WHEN 0 THEN 'rule' ELSE 'continuity' END AS kind, CASE n WHEN 0 THEN substr(repeat('high', 9), 1, 20) ELSE 'medium' END AS severity, substr(trim(fact, ' '), 1, 300) AS message, substr(trim(coalesce(snippet, ''), ' '), 1, 500) AS evidence, '' AS suggestion, '' AS highlight_text
FROM {kb_mentions}, (SELECT unnest([0, 2]) AS n) WHERE trim(fact, ' ') <> ''""")
def alerts_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four alerts each, the second without a message and the fourth too many"""
    fields = lambda *c: F.struct(*c, F.col("fact").alias("message"), F.col("snippet").alias("evidence"))
    none = F.lit(None).cast("string")
    first = fields(F.lit("rule").alias("kind"), F.lit("high" * 9).alias("severity"))
    other, blank = fields(none.alias("kind"), F.lit("").alias("severity")), F.struct(none.alias("kind"), none.alias("severity"), F.lit(" ").alias("message"), none.alias("evidence"))
    answer = F.to_json(F.struct(F.array(first, blank, other, first).alias("alerts")))
    return op.cleaned_alerts(view(spark, sf_dir, "kb_mentions").select(F.col("id").alias("key"), answer.alias("answer")))


@query(f"""
SELECT m.chapter_id, 'mention' AS part, m.id, concat_ws(' | ', e.canonical_name, e.type, m.fact) AS line FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id WHERE m.chapter_id IS NOT NULL
UNION ALL SELECT chapter_id, 'event', id, concat_ws(' | ', story_time, who, what, where_loc, why, consequence) FROM {{kb_happenings}} WHERE chapter_id IS NOT NULL
UNION ALL SELECT DISTINCT chapter_id, 'rule', id, name FROM (SELECT m.chapter_id, r.id, r.name FROM {{kb_rule_mentions}} m JOIN {{kb_rules}} r ON r.id = m.rule_id WHERE m.chapter_id IS NOT NULL UNION SELECT first_chapter_id, id, name FROM {{kb_rules}} WHERE first_chapter_id IS NOT NULL)
UNION ALL SELECT c, 'foreshadowing', id, concat_ws(' | ', status, hint, resolution) FROM (SELECT hint_chapter_id AS c, * FROM {{kb_foreshadowing}} WHERE hint_chapter_id IS NOT NULL UNION SELECT resolved_chapter_id, * FROM {{kb_foreshadowing}} WHERE resolved_chapter_id IS NOT NULL)
UNION ALL SELECT chapter_id, 'cross', id, line FROM (SELECT x.chapter_id, m.id, concat_ws(' | ', e.canonical_name, e.type, m.fact) AS line, row_number() OVER (PARTITION BY x.chapter_id ORDER BY e.canonical_name NULLS FIRST, e.id, c.idx, m.chapter_id, m.id) AS n
  FROM ({lookup_plans._ranked_pairs("f.chapter_id <> b.chapter_id", "f.idx, f.chapter_id, f.id", 15)}) x JOIN {{kb_mentions}} m ON m.id = x.mention_id JOIN {{kb_entities}} e ON e.id = m.entity_id JOIN {{kb_chapters}} c ON c.id = m.chapter_id) WHERE n <= 15""")
def reread_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every chapter before it is read again, with the first fifteen facts of its entities in other chapters"""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    other = lookups.elsewhere(lookup_plans._facts(spark, sf_dir), 15)
    return op.dossiers(v("kb_entities"), v("kb_mentions", "chapter_id IS NOT NULL"), v("kb_chapters"), v("kb_happenings", "chapter_id IS NOT NULL"), lookup_plans.chapter_rules(spark, sf_dir), v("kb_foreshadowing"), other)
