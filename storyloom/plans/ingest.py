"""Queries of operators/ingest.py: names resolved, chapters read first and again, records deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import STRIPPED_SQL, normal_name_sql, stripped
from storyloom.operators import ingest as op
from storyloom.plans.base import registry
from storyloom.plans.predicates import compatible_sql
from storyloom.session import written
from storyloom.sources.views import view

QUERIES, SQL, query = registry()
_S, _N = STRIPPED_SQL.format, normal_name_sql
_NOT_GIVEN = "coalesce(nullif({0}, ''), '未分类')"


# ---- names: aliases as names, names with a mark added, names in wide letters

_LATIN, _WIDE = "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "kb_entities", "book_id IS NOT NULL")
    name, none = F.col("canonical_name"), F.array().cast("array<string>")
    said = [
        rows.select("book_id", "id", "type", F.lit(0).alias("place"), F.explode("aliases").alias("name"), F.array(name).alias("aliases")),
        rows.select("book_id", "id", "type", F.lit(1), F.concat(name, F.lit("!")), none),
        rows.select("book_id", "id", "type", F.lit(2), F.translate(name, _LATIN, _WIDE), F.array(F.concat(name, F.lit("?")))),
    ]
    rows = reduce(DataFrame.union, said).select(
        "book_id", F.col("id").alias("chapter_id"), F.struct(F.lit(0).alias("idx"), F.col("id").alias("chapter_id"), "place").alias("at"), stripped(F.col("name")).alias("name"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit(op.NO_TYPE)).alias("type"), "aliases",
    )
    return rows.where("name <> ''")


_INCOMING = f"""(SELECT book_id, 0 AS idx, id AS ch, place, {_S('name')} AS name, {_NOT_GIVEN.format('type')} AS type, al FROM (
  SELECT book_id, id, type, 0 AS place, unnest(aliases) AS name, [canonical_name] AS al FROM {{kb_entities}} UNION ALL SELECT book_id, id, type, 1, concat(canonical_name, '!'), [] FROM {{kb_entities}} WHERE canonical_name IS NOT NULL
  UNION ALL SELECT book_id, id, type, 2, translate(canonical_name, '{_LATIN}', '{_WIDE}'), [concat(canonical_name, '?')] FROM {{kb_entities}}) WHERE book_id IS NOT NULL AND {_S('name')} <> '')"""


def resolution(incoming: str, entities: str, prefix: str = "r") -> str:
    """CTEs for DuckDB: {prefix}_found (book_id, name, entity_id, how, called, type, idx, ch, place, first_chapter_id) and {prefix}_own (book_id, name, a, idx, ch, place, n), from incoming (book_id, idx, ch, place, name, type, al) and entities."""
    return f"""
{prefix}_inc AS MATERIALIZED (SELECT * FROM {incoming}), {prefix}_ents AS MATERIALIZED (SELECT * FROM {entities}),
{prefix}_first AS (SELECT book_id, name, arg_min(type, (idx, ch, place)) AS type, arg_min(ch, (idx, ch, place)) AS ch, min(idx) AS idx, arg_min(place, (idx, ch, place)) AS place FROM {prefix}_inc GROUP BY book_id, name),
{prefix}_said AS (SELECT book_id, name, idx, ch, place, unnest(al) AS raw, unnest(range(len(al))) AS n FROM {prefix}_inc),
{prefix}_own AS MATERIALIZED (SELECT book_id, name, a, min(idx) AS idx, arg_min(ch, (idx, ch, place, n)) AS ch, arg_min(place, (idx, ch, place, n)) AS place, arg_min(n, (idx, ch, place, n)) AS n
  FROM (SELECT book_id, name, idx, ch, place, {_S('raw')} AS a, n FROM {prefix}_said) WHERE a <> '' AND a <> name GROUP BY book_id, name, a),
{prefix}_alias AS MATERIALIZED (SELECT DISTINCT book_id, entity_id, other, {_N('raw')} AS norm FROM (SELECT book_id, id AS entity_id, type AS other, {_S('canonical_name')} AS raw FROM {prefix}_ents
  UNION SELECT book_id, id, type, {_S('a')} FROM (SELECT book_id, id, type, unnest(aliases) AS a FROM {prefix}_ents)) CROSS JOIN {{nfkc}} nf WHERE raw <> ''),
{prefix}_exact AS (SELECT book_id, canonical_name AS name, min(id) AS exact_id FROM {prefix}_ents GROUP BY ALL),
{prefix}_step AS (SELECT f.*, x.exact_id FROM {prefix}_first f LEFT JOIN {prefix}_exact x ON x.book_id = f.book_id AND x.name = f.name),
{prefix}_check AS MATERIALIZED (SELECT s.book_id, s.name, s.type, s.c, {_N('s.said')} AS norm FROM (SELECT book_id, name, type, 0 AS c, name AS said FROM {prefix}_step WHERE exact_id IS NULL
  UNION ALL SELECT o.book_id, o.name, t.type, row_number() OVER (PARTITION BY o.book_id, o.name ORDER BY o.idx, o.ch, o.place, o.n), o.a FROM {prefix}_own o JOIN {prefix}_step t ON t.book_id = o.book_id AND t.name = o.name AND t.exact_id IS NULL) s CROSS JOIN {{nfkc}} nf),
{prefix}_hit AS (SELECT c.book_id, c.name, arg_min(a.entity_id, (c.c, a.entity_id)) AS alias_id FROM {prefix}_check c JOIN {prefix}_alias a ON a.book_id = c.book_id AND a.norm = c.norm AND {compatible_sql('c.type', 'a.other')} GROUP BY ALL),
{prefix}_new AS (SELECT s.book_id, s.name, s.type, s.idx, s.ch, s.place, c.norm FROM {prefix}_step s JOIN {prefix}_check c ON c.book_id = s.book_id AND c.name = s.name AND c.c = 0 WHERE s.exact_id IS NULL AND NOT EXISTS (SELECT 1 FROM {prefix}_hit h WHERE h.book_id = s.book_id AND h.name = s.name)),
{prefix}_head AS (SELECT book_id, norm, arg_min(name, (idx, ch, place, name)) AS name, arg_min(type, (idx, ch, place, name)) AS type FROM {prefix}_new GROUP BY ALL),
{prefix}_called AS (SELECT n.book_id, n.name, CASE WHEN {compatible_sql('n.type', 'h.type')} THEN h.name ELSE n.name END AS called FROM {prefix}_new n JOIN {prefix}_head h ON h.book_id = n.book_id AND h.norm = n.norm),
{prefix}_found AS MATERIALIZED (SELECT s.book_id, s.name, coalesce(s.exact_id, h.alias_id, sha256(concat('entity|', s.book_id, '|', c.called))) AS entity_id, CASE WHEN s.exact_id IS NOT NULL THEN 'exact' WHEN h.alias_id IS NOT NULL THEN 'alias' ELSE 'new' END AS how,
  c.called, s.type, s.idx, s.ch, s.place FROM {prefix}_step s LEFT JOIN {prefix}_hit h ON h.book_id = s.book_id AND h.name = s.name LEFT JOIN {prefix}_called c ON c.book_id = s.book_id AND c.name = s.name)"""


@query(f"WITH {resolution(_INCOMING, '{kb_entities}')} SELECT book_id, name, entity_id, how FROM r_found")
def names_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R2 (exact and alias steps), J8, P8, F1"""
    entities = view(spark, sf_dir, "kb_entities")
    return op.resolved(_incoming(spark, sf_dir), entities, op.alias_rows(entities)).select("book_id", "name", "entity_id", "how")


@query(f"""
WITH {resolution(_INCOMING, '{kb_entities}')},
more AS (SELECT DISTINCT f.entity_id, o.a FROM r_found f JOIN r_own o ON o.book_id = f.book_id AND o.name = f.name WHERE f.how <> 'new'),
old AS (SELECT id AS entity_id, canonical_name, {_S('a')} AS a, n FROM (SELECT id, canonical_name, unnest(aliases) AS a, unnest(range(len(aliases))) AS n FROM {{kb_entities}})),
joined AS (SELECT o.entity_id, o.canonical_name, o.a FROM old o WHERE EXISTS (SELECT 1 FROM more m WHERE m.entity_id = o.entity_id) UNION SELECT m.entity_id, e.canonical_name, m.a FROM more m JOIN {{kb_entities}} e ON e.id = m.entity_id),
lists AS (SELECT entity_id, list_sort(list(a)) AS aliases FROM joined WHERE a <> '' AND a IS DISTINCT FROM canonical_name GROUP BY ALL),
chap AS (SELECT entity_id, arg_min(ch, (idx, ch, place, ch)) AS c FROM r_found WHERE how <> 'new' GROUP BY ALL),
fresh AS (SELECT f.entity_id, f.called, x.own FROM r_found f, (SELECT book_id, name, name AS own FROM r_found UNION SELECT book_id, name, a FROM r_own) x WHERE f.how = 'new' AND x.book_id = f.book_id AND x.name = f.name AND x.own <> f.called),
freshlists AS (SELECT entity_id, list_sort(list(DISTINCT own)) AS aliases FROM fresh GROUP BY ALL)
SELECT e.id, e.canonical_name, CASE WHEN EXISTS (SELECT 1 FROM more m WHERE m.entity_id = e.id) THEN coalesce(l.aliases, []) ELSE list_sort(list_filter(coalesce(e.aliases, []), lambda x: x IS NOT NULL)) END AS aliases, coalesce(nullif(e.first_chapter_id, ''), c.c) AS first_chapter_id,
  coalesce(nullif(e.name_norm, ''), {_N('e.canonical_name')}) AS name_norm FROM {{kb_entities}} e CROSS JOIN {{nfkc}} nf LEFT JOIN lists l ON l.entity_id = e.id LEFT JOIN chap c ON c.entity_id = e.id
UNION ALL SELECT f.entity_id, f.called, coalesce(l.aliases, []), f.ch, {_N('f.called')} FROM r_found f CROSS JOIN {{nfkc}} nf LEFT JOIN freshlists l ON l.entity_id = f.entity_id WHERE f.how = 'new' AND f.name = f.called""")
def entities_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities after the names came in; lists are sorted for comparison"""
    entities = view(spark, sf_dir, "kb_entities")
    found = op.resolved(_incoming(spark, sf_dir), entities, op.alias_rows(entities))
    return op.entities_after(entities, found).select("id", "canonical_name", F.array_sort(F.filter("aliases", lambda a: a.isNotNull())).alias("aliases"), "first_chapter_id", "name_norm")


@query(f"""
SELECT DISTINCT book_id, entity_id, {_N('raw')} AS alias_norm, raw AS alias_raw FROM (SELECT book_id, id AS entity_id, {_S('canonical_name')} AS raw FROM {{kb_entities}}
  UNION SELECT book_id, id, {_S('a')} FROM (SELECT book_id, id, unnest(aliases) AS a FROM {{kb_entities}})) CROSS JOIN {{nfkc}} nf WHERE raw <> ''""")
def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling of an entity once, with its normal form"""
    return op.alias_rows(view(spark, sf_dir, "kb_entities"))


@query(f"""
SELECT e.id, coalesce(nullif(e.name_norm, ''), {_N('e.canonical_name')}) AS name_norm, coalesce(m.n, 0) AS mention_cnt FROM {{kb_entities}} e CROSS JOIN {{nfkc}} nf LEFT JOIN (SELECT entity_id, count(*) AS n FROM {{kb_mentions}} GROUP BY ALL) m ON m.entity_id = e.id""")
def entities_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms that are missing, and counters, derived"""
    return op.backfilled(view(spark, sf_dir, "kb_entities"), view(spark, sf_dir, "kb_mentions")).select("id", "name_norm", "mention_cnt")


# ---- results: every chapter read again with a quarter of its facts gone, a quarter changed, the rest only spaced differently


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_id, idx, result) as JSON text, one of every chapter of a book that has an index and a text to read."""
    v = lambda n, where=None: view(spark, sf_dir, n, where)
    every = v("kb_chapters", "book_id IS NOT NULL AND idx IS NOT NULL").select("book_id", F.col("id").alias("chapter_id"), "idx")
    chapters = every.join(v("kb_texts", stripped(F.col("content")) != "").select("chapter_id"), "chapter_id", "left_semi")
    t, none = F.col("created_at") % 4, F.lit(None).cast("string")
    own = v("kb_entities").select(F.col("id").alias("entity_id"), "book_id", "canonical_name")
    fact = F.when(t == 2, F.concat("fact", F.lit("（新）"))).otherwise(F.concat(F.lit(" "), "fact", F.lit(" ")))
    facts = v("kb_mentions", t != 1).join(own, "entity_id").join(chapters, ["chapter_id", "book_id"]).select("chapter_id", "canonical_name", "id", F.struct(fact.alias("fact"), "snippet").alias("f"))
    facts = facts.groupBy("chapter_id", "canonical_name").agg(F.array_sort(F.collect_list(F.struct("id", "f"))).alias("fs"))
    one = F.struct("canonical_name", F.struct("canonical_name", F.lit("").alias("type"), F.array().cast("array<string>").alias("aliases_in_chapter"), F.transform("fs", lambda x: x["f"]).alias("facts")).alias("e"))
    lists = {"entities": facts.groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("entities"))}
    event = F.struct("story_time", "who", F.concat(F.lit(" "), "what").alias("what"), F.col("where_loc").alias("where"), "why", "consequence")
    lists["events"] = v("kb_happenings", F.col("created_at") % 3 != 0).groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", event.alias("e")))), lambda x: x["e"]).alias("events"))
    hints = v("kb_foreshadowing").withColumnRenamed("hint_chapter_id", "chapter_id")
    lists["planted"] = hints.where("updated_at % 2 = 0").groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct("hint", none.alias("snippet")).alias("h")))), lambda x: x["h"]).alias("foreshadowing_new"))
    lists["resolved"] = hints.where("updated_at % 5 = 0").groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(F.col("hint").alias("earlier_hint"), F.concat(F.lit("by "), "id").alias("resolution"), none.alias("snippet")).alias("h")))), lambda x: x["h"]).alias("foreshadowing_resolved"))
    rules = v("kb_rule_mentions").join(v("kb_rules").select(F.col("id").alias("rule_id"), "book_id", "name", "body"), "rule_id").join(chapters, ["chapter_id", "book_id"])
    rule = F.struct("name", F.concat("body", F.lit(" v"), F.col("idx").cast("string")).alias("body"), F.when(F.col("created_at") % 2 == 0, F.col("evidence")).alias("snippet"))
    lists["rules"] = rules.groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", rule.alias("r")))), lambda x: x["r"]).alias("rules"))
    wrong = v("kb_mentions", "created_at % 7 = 0").join(own, "entity_id").join(every.select("book_id", "chapter_id", F.col("idx").alias("of_idx")), ["chapter_id", "book_id"])
    # each correction is stated by the chapter after the mention's own, where there is one
    after = chapters.select("book_id", (F.col("idx") - 1).alias("of_idx"), F.col("chapter_id").alias("by")).groupBy("book_id", "of_idx").agg(F.min("by").alias("by"))
    fixed = F.struct(F.col("id").alias("mention_id"), "chapter_id", F.when(F.col("created_at") % 2 == 0, F.concat(F.lit("right: "), "fact")).otherwise("").alias("correct_fact"), none.alias("correct_snippet"), F.lit("checked").alias("reason"))
    lists["corrections"] = wrong.join(after, ["book_id", "of_idx"]).groupBy(F.col("by").alias("chapter_id")).agg(F.array_sort(F.collect_list(fixed)).alias("corrections"))
    rows = chapters
    for part in lists.values():
        rows = rows.join(part, "chapter_id", "left")
    fields = ("entities", "events", "foreshadowing_new", "foreshadowing_resolved", "rules", "corrections")
    return rows.select("book_id", "chapter_id", "idx", F.to_json(F.struct(*fields)).alias("result"))


def _kb(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = lambda n: view(spark, sf_dir, n)
    return {"chapters": v("kb_chapters"), "entities": v("kb_entities"), "mentions": v("kb_mentions"), "events": v("kb_happenings"), "foreshadowing": v("kb_foreshadowing"), "rules": v("kb_rules"), "rule_mentions": v("kb_rule_mentions")}


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.parsed(written(results(spark, sf_dir), "results"))


_SAID = "CASE WHEN m.created_at % 4 = 2 THEN m.fact || '（新）' ELSE ' ' || m.fact || ' ' END"
_CHAPTERS = f"allc AS MATERIALIZED (SELECT id AS chapter_id, book_id, idx, status FROM {{kb_chapters}} WHERE book_id IS NOT NULL AND idx IS NOT NULL), cs AS MATERIALIZED (SELECT * FROM allc WHERE chapter_id IN (SELECT chapter_id FROM {{kb_texts}} WHERE {_S('content')} <> '')), fresh AS (SELECT chapter_id FROM cs WHERE coalesce(status, '') <> 'done'), done AS (SELECT chapter_id FROM cs WHERE status = 'done')"
_LEFT = f"""{_CHAPTERS}, kept AS MATERIALIZED (SELECT * FROM {{kb_mentions}} WHERE coalesce(chapter_id NOT IN (SELECT chapter_id FROM fresh), true)),
ents AS MATERIALIZED (SELECT * FROM {{kb_entities}} e WHERE NOT (coalesce(e.first_chapter_id IN (SELECT chapter_id FROM fresh), false) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.entity_id = e.id))),
told AS MATERIALIZED (SELECT c.book_id, c.idx, c.chapter_id, e.canonical_name AS given, {_S('e.canonical_name')} AS name, m.id, {_S(_SAID)} AS fact
  FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = e.book_id WHERE m.created_at % 4 <> 1),
names AS MATERIALIZED (SELECT DISTINCT book_id, idx, chapter_id AS ch, dense_rank() OVER (PARTITION BY chapter_id ORDER BY given) - 1 AS place, name, '未分类' AS type, CAST([] AS VARCHAR[]) AS al FROM told)"""
_TOLD = f"""{_LEFT}, {resolution("(SELECT * FROM names WHERE name <> '')", 'ents')},
said AS MATERIALIZED (SELECT DISTINCT t.chapter_id, f.entity_id, {_N('t.fact')} AS norm FROM told t JOIN r_found f ON f.book_id = t.book_id AND f.name = t.name CROSS JOIN {{nfkc}} nf WHERE t.fact <> ''),
spoken AS MATERIALIZED (SELECT t.chapter_id, f.entity_id, t.fact FROM told t JOIN r_found f ON f.book_id = t.book_id AND f.name = t.name WHERE t.fact <> ''),
olds AS MATERIALIZED (SELECT k.chapter_id, {_N('k.fact')} AS norm, k.id, k.created_at, k.entity_id, k.fact, k.confidence, k.pass_no FROM kept k CROSS JOIN {{nfkc}} nf WHERE k.chapter_id IN (SELECT chapter_id FROM done)),
last AS MATERIALIZED (SELECT chapter_id, norm, arg_max(struct_pack(id := id, entity_id := entity_id, fact := fact, confidence := confidence, pass_no := pass_no), (created_at, id)) AS o FROM olds GROUP BY ALL)"""
_WRONG = """wrong AS MATERIALIZED (SELECT k.id, k.entity_id, k.chapter_id, k.fact, k.created_at, k.confidence, k.pass_no FROM kept k JOIN ents e ON e.id = k.entity_id JOIN allc c ON c.chapter_id = k.chapter_id AND c.book_id = e.book_id
  JOIN (SELECT book_id, idx, min(chapter_id) AS ch FROM cs GROUP BY ALL) b ON b.book_id = c.book_id AND b.idx = c.idx + 1 WHERE k.created_at % 7 = 0 AND b.ch IN (SELECT chapter_id FROM done) AND k.chapter_id NOT IN (SELECT chapter_id FROM cs))"""


@query(f"""
WITH {_TOLD}, {_WRONG} SELECT entity_id, chapter_id, fact_norm, confidence, pass_no FROM (
  SELECT s.entity_id, s.chapter_id, s.norm AS fact_norm, CASE WHEN l.o IS NULL THEN 0.7 ELSE round(least(0.95, coalesce(l.o.confidence, 0.6) + 0.1), 6) END AS confidence, CASE WHEN l.o IS NULL THEN 2 ELSE coalesce(l.o.pass_no, 1) + 1 END AS pass_no
  FROM said s LEFT JOIN last l ON l.chapter_id = s.chapter_id AND l.norm = s.norm WHERE s.chapter_id IN (SELECT chapter_id FROM done)
  UNION ALL SELECT entity_id, chapter_id, {_N('fact')}, 0.6, 1 FROM spoken CROSS JOIN {{nfkc}} nf WHERE chapter_id IN (SELECT chapter_id FROM fresh)
  UNION ALL SELECT entity_id, chapter_id, {_N('fact')}, round(confidence, 6), pass_no FROM kept CROSS JOIN {{nfkc}} nf WHERE coalesce(chapter_id NOT IN (SELECT chapter_id FROM done), true) AND id NOT IN (SELECT id FROM wrong)
  UNION ALL SELECT entity_id, chapter_id, {_N("concat('right: ', fact)")}, 0.7, 2 FROM wrong CROSS JOIN {{nfkc}} nf WHERE created_at % 2 = 0 AND fact IS NOT NULL)""")
def facts_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions after the results came in"""
    from storyloom.functions.text import normal_name_udf

    rows = op.facts_applied(_kb(spark, sf_dir), _results(spark, sf_dir))["mentions"]
    return rows.select("entity_id", "chapter_id", normal_name_udf("fact").alias("fact_norm"), F.round("confidence", 6).alias("confidence"), "pass_no")


@query(f"""
WITH {_TOLD}, {_WRONG} SELECT l.o.entity_id AS entity_id, l.chapter_id, l.o.fact AS fact, l.o.confidence AS confidence, l.o.pass_no AS pass_no, 'superseded' AS status, l.o.id AS supersedes, '重读后不再出现' AS reason FROM last l
WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.chapter_id = l.chapter_id AND s.norm IS NOT DISTINCT FROM l.norm)
UNION ALL SELECT entity_id, chapter_id, fact, confidence, pass_no, 'superseded', id, '顺手校对: checked' FROM wrong""")
def facts_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of facts that a repeated reading no longer finds, or that another chapter's reading corrects"""
    return op.facts_applied(_kb(spark, sf_dir), _results(spark, sf_dir))["fact_revisions"].select("entity_id", "chapter_id", "fact", "confidence", "pass_no", "status", "supersedes", "reason")


@query(f"""
WITH {_CHAPTERS}, s AS (SELECT {_S("concat(' ', what)")} AS said, chapter_id FROM {{kb_happenings}} WHERE created_at % 3 <> 0 AND chapter_id IN (SELECT chapter_id FROM cs)),
planted AS (SELECT c.book_id, c.idx, f.hint_chapter_id AS chapter_id, {_S('f.hint')} AS hint FROM {{kb_foreshadowing}} f JOIN cs c ON c.chapter_id = f.hint_chapter_id WHERE f.updated_at % 2 = 0),
left_ AS (SELECT book_id, hint_chapter_id, hint, status, resolved_chapter_id, resolution FROM {{kb_foreshadowing}} WHERE coalesce(hint_chapter_id NOT IN (SELECT chapter_id FROM cs), true) AND coalesce(resolved_chapter_id NOT IN (SELECT chapter_id FROM fresh), true)),
every AS (SELECT * FROM left_ UNION ALL SELECT book_id, chapter_id, hint, 'open', NULL, NULL FROM planted WHERE hint <> ''),
res AS (SELECT c.book_id, {_S('f.hint')} AS hint, arg_min(struct_pack(ch := c.chapter_id, r := concat('by ', f.id)), (c.idx, c.chapter_id, f.id)) AS r FROM {{kb_foreshadowing}} f JOIN cs c ON c.chapter_id = f.hint_chapter_id WHERE f.updated_at % 5 = 0 AND {_S('f.hint')} <> '' GROUP BY ALL)
SELECT 'event' AS kind, said, chapter_id, NULL AS status, NULL AS resolved_chapter_id FROM s WHERE said <> '' UNION ALL SELECT 'event', what, chapter_id, NULL, NULL FROM {{kb_happenings}} WHERE coalesce(chapter_id NOT IN (SELECT chapter_id FROM cs), true)
UNION ALL SELECT 'foreshadowing', e.hint, e.hint_chapter_id, CASE WHEN e.status = 'open' AND r.r IS NOT NULL THEN 'resolved' ELSE e.status END, CASE WHEN e.status = 'open' AND r.r IS NOT NULL THEN r.r.ch ELSE e.resolved_chapter_id END FROM every e LEFT JOIN res r ON r.book_id = e.book_id AND r.hint = e.hint""")
def events_and_hints_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and foreshadowing after the results came in"""
    after, none = op.records_applied(_kb(spark, sf_dir), _results(spark, sf_dir)), F.lit(None).cast("string")
    events = after["events"].select(F.lit("event").alias("kind"), F.col("what").alias("said"), "chapter_id", none.alias("status"), none.alias("resolved_chapter_id"))
    return events.union(after["foreshadowing"].select(F.lit("foreshadowing"), "hint", "hint_chapter_id", "status", "resolved_chapter_id"))


_RULES = f"""{_CHAPTERS}, stated AS MATERIALIZED (SELECT c.book_id, c.idx, c.chapter_id, m.id, {_S('r.name')} AS name, {_S("concat(r.body, ' v', CAST(c.idx AS VARCHAR))")} AS body, CASE WHEN m.created_at % 2 = 0 THEN nullif(m.evidence, '') END AS snippet
  FROM {{kb_rule_mentions}} m JOIN {{kb_rules}} r ON r.id = m.rule_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = r.book_id WHERE {_S('r.name')} <> ''),
kept AS MATERIALIZED (SELECT * FROM {{kb_rules}} WHERE coalesce(first_chapter_id NOT IN (SELECT chapter_id FROM cs), true)),
last AS (SELECT book_id, name, arg_max(body, (idx, chapter_id, id)) AS body, arg_min(chapter_id, (idx, chapter_id, id)) AS first FROM stated GROUP BY ALL),
rules AS MATERIALIZED (SELECT coalesce(k.id, sha256(concat('rule|', l.book_id, '|', l.name))) AS id, coalesce(k.book_id, l.book_id) AS book_id, coalesce(k.name, l.name) AS name, coalesce(l.body, k.body) AS body, CASE WHEN k.id IS NULL THEN l.first ELSE k.first_chapter_id END AS first_chapter_id
  FROM kept k FULL OUTER JOIN last l ON l.book_id = k.book_id AND l.name = k.name)"""


@query(f"WITH {_RULES} SELECT id, book_id, name, body, first_chapter_id FROM rules")
def rules_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules after the results came in"""
    return op.records_applied(_kb(spark, sf_dir), _results(spark, sf_dir))["rules"]


@query(f"""
WITH {_RULES}, old AS (SELECT m.rule_id, m.chapter_id, min(m.evidence) AS evidence FROM {{kb_rule_mentions}} m WHERE m.rule_id IN (SELECT id FROM kept) AND coalesce(m.chapter_id NOT IN (SELECT chapter_id FROM fresh), true) GROUP BY ALL),
new AS (SELECT r.id AS rule_id, s.chapter_id, arg_max(coalesce(s.snippet, substr(s.body, 1, 200)), (s.idx, s.chapter_id, s.id)) AS evidence FROM stated s JOIN rules r ON r.book_id = s.book_id AND r.name = s.name GROUP BY ALL)
SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, coalesce(n.chapter_id, o.chapter_id) AS chapter_id, coalesce(nullif(n.evidence, ''), o.evidence) AS evidence FROM old o FULL OUTER JOIN new n ON n.rule_id = o.rule_id AND n.chapter_id = o.chapter_id""")
def rule_mentions_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention of a rule a chapter"""
    return op.records_applied(_kb(spark, sf_dir), _results(spark, sf_dir))["rule_mentions"]


@query(f"""
WITH {_CHAPTERS} SELECT chapter_id, kind, count(*) AS n FROM (
  SELECT m.chapter_id, 'mentions' AS kind FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = e.book_id WHERE m.created_at % 4 <> 1 AND {_S('e.canonical_name')} <> '' AND {_S(_SAID)} <> ''
  UNION ALL SELECT chapter_id, 'events' FROM {{kb_happenings}} WHERE created_at % 3 <> 0 AND {_S('what')} <> '' UNION ALL SELECT hint_chapter_id, 'foreshadowing' FROM {{kb_foreshadowing}} WHERE updated_at % 2 = 0 AND {_S('hint')} <> ''
  UNION ALL SELECT hint_chapter_id, 'foreshadowing' FROM {{kb_foreshadowing}} WHERE updated_at % 5 = 0 AND {_S('hint')} <> ''
  UNION ALL SELECT m.chapter_id, 'rules' FROM {{kb_rule_mentions}} m JOIN {{kb_rules}} r ON r.id = m.rule_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = r.book_id WHERE {_S('r.name')} <> '') WHERE chapter_id IN (SELECT chapter_id FROM cs) GROUP BY ALL""")
def added_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What partial results add to each chapter, by kind"""
    return op.added_counts(_results(spark, sf_dir))


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "kb_deletions", "action = 'delete'").select("table_name", "record_id").distinct()
    v = lambda n: view(spark, sf_dir, n)
    own = v("kb_entities").select(F.col("id").alias("entity_id"), "book_id")
    mentions = v("kb_mentions").select("id", "entity_id").join(own, "entity_id").select("book_id", F.lit("mentions").alias("kind"), F.col("id").alias("record_id"))
    events = v("kb_happenings").select("book_id", F.lit("events"), "id")
    hints = v("kb_happenings").select("book_id", F.lit("foreshadowing"), F.concat(F.lit("f-"), "id"))
    rules = v("kb_entities").select("book_id", F.lit("rules"), "id")
    named = {"mentions": "mentions", "events": "kb_events", "foreshadowing": "kb_events", "rules": "entities"}
    plain = F.when(F.col("kind") == "foreshadowing", F.substring("record_id", 3, 1 << 20)).otherwise(F.col("record_id"))
    every = mentions.union(events).union(hints).union(rules)
    table = F.create_map(*(F.lit(x) for p in named.items() for x in p))[F.col("kind")]
    return every.withColumns({"table_name": table, "_id": plain}).join(log.withColumnRenamed("record_id", "_id"), ["table_name", "_id"], "left_semi").select("book_id", "kind", "record_id")


_LOG = "(SELECT record_id FROM kb_deletions WHERE action = 'delete' AND table_name = '{0}')"
_COUNTS = f"""SELECT e.book_id, 'mentions' AS kind, m.id FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id WHERE m.id IN {_LOG.format('mentions')}
  UNION ALL SELECT book_id, 'events', id FROM {{kb_happenings}} WHERE id IN {_LOG.format('kb_events')} UNION ALL SELECT f.book_id, 'foreshadowing', f.id FROM {{kb_foreshadowing}} f WHERE substr(f.id, 3) IN {_LOG.format('kb_events')}
  UNION ALL SELECT book_id, 'rules', id FROM {{kb_rules}} WHERE id IN {_LOG.format('entities')}"""


@query(f"SELECT book_id, kind, count(*) AS n FROM ({_COUNTS}) WHERE book_id IS NOT NULL GROUP BY ALL")
def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records removed by id, by book and kind"""
    return op.without_records(_kb(spark, sf_dir), _gone(spark, sf_dir))[1]


@query(f"""
WITH gone AS MATERIALIZED ({_COUNTS}), books AS (SELECT book_id FROM gone UNION SELECT book_id FROM {{kb_entities}} WHERE id IN {_LOG.format('entities')} UNION SELECT book_id FROM {{kb_happenings}} WHERE id IN {_LOG.format('kb_events')}),
named AS (SELECT entity_id FROM {{kb_mentions}} WHERE entity_id IS NOT NULL AND id NOT IN (SELECT id FROM gone WHERE kind = 'mentions'))
SELECT id, canonical_name FROM {{kb_entities}} WHERE coalesce(book_id NOT IN (SELECT book_id FROM books WHERE book_id IS NOT NULL), true) OR id IN (SELECT entity_id FROM named)""")
def entities_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after records were removed by id and those without a mention purged from the books concerned"""
    return op.without_records(_kb(spark, sf_dir), _gone(spark, sf_dir))[0]["entities"].select("id", "canonical_name")


@query(f"""
WITH {_CHAPTERS} SELECT DISTINCT chapter_id, source_type, source FROM (SELECT chapter_id, 'chapter_summary' AS source_type, 'summary' AS source FROM cs
  UNION ALL SELECT m.chapter_id, 'entity', e.canonical_name FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = e.book_id WHERE m.created_at % 4 <> 1 AND e.canonical_name IS NOT NULL
  UNION ALL SELECT chapter_id, 'event', substr(' ' || what, 1, 80) FROM {{kb_happenings}} WHERE created_at % 3 <> 0 UNION ALL SELECT hint_chapter_id, 'foreshadowing', substr(hint, 1, 80) FROM {{kb_foreshadowing}} WHERE updated_at % 2 = 0
  UNION ALL SELECT m.chapter_id, 'rule', r.name FROM {{kb_rule_mentions}} m JOIN {{kb_rules}} r ON r.id = m.rule_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = r.book_id) WHERE chapter_id IN (SELECT chapter_id FROM cs) AND source IS NOT NULL""")
def affected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every result touches"""
    return op.affected_sources(_results(spark, sf_dir)).where("source IS NOT NULL")


@query(f"""
WITH {_CHAPTERS}, gone AS ({_COUNTS}), add_ AS (
  SELECT c.book_id, 'mentions' AS kind, count(*) AS n FROM {{kb_mentions}} m JOIN {{kb_entities}} e ON e.id = m.entity_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = e.book_id WHERE m.created_at % 4 <> 1 AND {_S('e.canonical_name')} <> '' AND {_S(_SAID)} <> '' GROUP BY ALL
  UNION ALL SELECT c.book_id, 'events', count(*) FROM {{kb_happenings}} h JOIN cs c ON c.chapter_id = h.chapter_id WHERE h.created_at % 3 <> 0 AND {_S('h.what')} <> '' GROUP BY ALL
  UNION ALL SELECT c.book_id, 'foreshadowing', sum(CASE WHEN f.updated_at % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN f.updated_at % 5 = 0 THEN 1 ELSE 0 END) FROM {{kb_foreshadowing}} f JOIN cs c ON c.chapter_id = f.hint_chapter_id WHERE {_S('f.hint')} <> '' AND (f.updated_at % 2 = 0 OR f.updated_at % 5 = 0) GROUP BY ALL
  UNION ALL SELECT c.book_id, 'rules', count(*) FROM {{kb_rule_mentions}} m JOIN {{kb_rules}} r ON r.id = m.rule_id JOIN cs c ON c.chapter_id = m.chapter_id AND c.book_id = r.book_id WHERE {_S('r.name')} <> '' GROUP BY ALL),
rem AS (SELECT book_id, kind, count(*) AS n FROM gone WHERE book_id IN (SELECT book_id FROM cs) GROUP BY ALL)
SELECT coalesce(r.book_id, a.book_id) AS book_id, coalesce(r.kind, a.kind) AS kind, coalesce(r.n, 0) AS removed, CAST(coalesce(a.n, 0) AS BIGINT) AS added FROM rem r FULL OUTER JOIN add_ a ON a.book_id = r.book_id AND a.kind = r.kind""")
def patches_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter read again in part: the logged deletions of its book go, its results are added"""
    gone = _gone(spark, sf_dir).groupBy("book_id").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("record_id"))).alias(k) for k in ("mentions", "events", "rules", "foreshadowing")))
    first = results(spark, sf_dir)
    one = first.groupBy("book_id").agg(F.min("chapter_id").alias("chapter_id")).join(gone, "book_id")  # the deletions of a book are stated by its first chapter; as many as are logged
    rows = first.join(one, ["book_id", "chapter_id"], "left")
    delete = F.to_json(F.struct("mentions", "events", "rules", "foreshadowing"))
    patch = F.concat(F.lit('{"delete":'), delete, F.lit(',"add":'), "result", F.lit(',"note":"as stated"}'))
    return op.patched(_kb(spark, sf_dir), rows.select("book_id", "chapter_id", "idx", patch.alias("patch")))[1]
